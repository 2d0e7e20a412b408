"""Column builders: text to words, tokens, sentences, lines, and scalar helpers."""
