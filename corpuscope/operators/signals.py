"""Per-document signals of the distributional, reasoning and artifact families.

Counting words within one document needs no other document, so no shuffle: relational plans for it
(explode, group by document and word) would move every word of the corpus. The counts are made in
one Arrow pass over the texts, which also finds the artifact patterns: as column expressions they took three
times as long, since words, folded texts and patterns met Java's Unicode classes character by character.

A signal below its minimum size is null, never 0. Null texts count as empty.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..constants import ABBREVIATIONS, APOSTROPHES, ASSISTANT_ECHO, BOLD_LEAD, HEDGING, INFORMAL, LEXICON, LOWER_I, REPEATED_PUNCTUATION, STOPWORDS, SUFFIXES, TRANSITIONS
from .components import give_back, texts_of

# Patterns as Python's re has them: fixed values.
WORD_RE = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
TOKEN_RE = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+(?:[.,:/]\d+)*|[^\w\s]")
BOUNDARY_RE = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+")

DISTRIBUTIONAL = ("unigram_entropy", "normalized_entropy", "hapax_ratio", "yules_k", "conditional_bigram_entropy", "mtld", "zipf_slope", "spectrum_slope", "heaps_beta", "repetition_4gram", "repetition_8gram", "compression_ratio")
REASONING = ("step_novelty", "stalled_step_ratio")
ARTIFACT = ("assistant_echo_rate", "hedging_rate", "llm_lexicon_rate", "human_noise_rate", "transition_rate", "bold_lead_rate")


def _latin(text: str) -> bool:
    """Whether all characters are Latin-1, in which case changes neither a word's bounds nor depends on its place."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def words_of(text: str) -> list[str]:
    return WORD_RE.findall(text.lower()) if _latin(text) else [w.lower() for w in WORD_RE.findall(text)]


def sentences_of(text: str) -> list[str]:
    """Sentences of a text; pieces that end on an abbreviation or initial join the next."""
    out, held = [], []
    for piece in filter(None, map(str.strip, BOUNDARY_RE.split(text))):
        held.append(piece)
        bare = piece.rstrip("\"'”’)]")
        last = bare[:-1].split()[-1:] if bare.endswith(".") else []
        word = last[0].lower().strip("([\"'") if last else ""
        if not (word in ABBREVIATIONS or (len(word) == 1 and word.isalpha())):
            out.append(" ".join(held))
            held = []
    return out + ([" ".join(held)] if held else [])


def line_fit(points: Sequence[tuple[float, float]]) -> tuple[float, float] | None:
    """Slope and R² of a least-squares line; R² is 1 where y does not vary, None where x does not."""
    n = len(points)
    mx, my = sum(x for x, _ in points) / n, sum(y for _, y in points) / n
    sxx = sum((x - mx) ** 2 for x, _ in points)
    if n < 2 or sxx <= 0:
        return None
    sxy = sum((x - mx) * (y - my) for x, y in points)
    syy = sum((y - my) ** 2 for _, y in points)
    return sxy / sxx, 1.0 if syy <= 0 else sxy * sxy / (sxx * syy)


def _slope(points: list[tuple[float, float]]) -> float | None:
    fit = line_fit(points) if points else None
    return fit[0] if fit and fit[1] >= 0.5 else None


def mtld_pass(words: Sequence[str], threshold: float = 0.72) -> float:
    """Words per factor: a factor ends where types over words fall to the threshold."""
    factors, begun, types = 0.0, 0, set()
    for at, word in enumerate(words, 1):
        types.add(word)
        if len(types) / (at - begun) <= threshold:
            factors, begun, types = factors + 1, at, set()
    rest = len(words) - begun
    if rest:
        factors += (1 - len(types) / rest) / (1 - threshold)
    return len(words) / factors if factors > 0 else float(len(words))


def branching(words: Sequence[str]) -> float | None:
    """Entropy of the next word after words that are followed at least twice."""
    followed = Counter(words[:-1])
    kept = {w for w, n in followed.items() if n > 1}
    if len(words) < 3 or len(kept) < 5:
        return None
    pairs = Counter(p for p in zip(words, words[1:]) if p[0] in kept)
    total = sum(pairs.values())
    return -sum(n / total * math.log2(n / followed[w]) for (w, _), n in pairs.items())


def growth(words: Sequence[str]) -> float | None:
    """Heaps' exponent over prefixes at equal steps of the logarithm, from 50 words on."""
    n = len(words)
    if n < 100:
        return None
    lo, hi = math.log(50), math.log(n)
    step = (hi - lo) / 11
    marks = {p for p in (int(math.exp(lo + i * step)) for i in range(12)) if 50 <= p <= n}
    first = sorted({w: i for i, w in reversed(list(enumerate(words)))}.values())
    points, seen = [], 0
    for p in sorted(marks):
        while seen < len(first) and first[seen] < p:
            seen += 1
        points.append((math.log(p), math.log(seen)))
    return _slope(points) if len(points) >= 5 else None


def repetition(tokens: Sequence[str], n: int) -> float | None:
    """Share of n-grams that repeat an earlier one; needs ten n-gram lengths of tokens."""
    if len(tokens) < 10 * n:
        return None
    grams = list(zip(*(tokens[i:] for i in range(n))))
    return 1 - len(set(grams)) / len(grams)


def distributional(text: str, words: list[str]) -> dict[str, float | None]:
    out: dict[str, float | None] = dict.fromkeys(DISTRIBUTIONAL)
    n = len(words)
    if n >= 3:
        counts = Counter(words)
        spectrum = Counter(counts.values())
        entropy = -sum(v * c / n * math.log2(c / n) for c, v in spectrum.items())
        out["unigram_entropy"] = entropy
        out["normalized_entropy"] = entropy / math.log2(len(counts)) if len(counts) > 1 else 0.0
        out["hapax_ratio"] = spectrum[1] / len(counts)
        out["yules_k"] = 1e4 * (sum(c * c * v for c, v in spectrum.items()) - n) / (n * n)
        out["conditional_bigram_entropy"] = branching(words)
        if n >= 50:
            out["mtld"] = (mtld_pass(words) + mtld_pass(words[::-1])) / 2
        if len(counts) >= 40 and len(spectrum) > 1:
            out["zipf_slope"] = _slope([(math.log(r), math.log(c)) for r, c in enumerate(sorted(counts.values(), reverse=True), 1)])
        points = [(math.log(i), math.log(spectrum[i])) for i in range(1, 11) if spectrum[i]]
        if n >= 2000 and len(points) >= 4:
            out["spectrum_slope"] = _slope(points)
        out["heaps_beta"] = growth(words)
    tokens = TOKEN_RE.findall(text)
    out["repetition_4gram"], out["repetition_8gram"] = repetition(tokens, 4), repetition(tokens, 8)
    raw = text.encode("utf-8", "replace")
    if len(raw) >= 500:
        out["compression_ratio"] = len(zlib.compress(raw, 6)) / len(raw)
    return out


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """Without one possessive, then without the first fitting ending that leaves three letters."""
    mark = next((p for p in ("'s", "’s", "'", "’") if word.endswith(p) and len(word) > len(p)), "")
    word = word[: len(word) - len(mark)]
    ending = next((s for s in SUFFIXES if word.endswith(s) and len(word) >= len(s) + 3), "")
    return word[: len(word) - len(ending)]


_STOP = frozenset(STOPWORDS)


def reasoning(sentences: Sequence[str]) -> dict[str, float | None]:
    """Novelty of each step's content against the three steps before it."""
    steps = [s for s in ({stem(w) for w in words_of(x) if len(w) > 1 and w not in _STOP} for x in sentences) if len(s) > 1]
    if len(steps) < 5:
        return dict.fromkeys(REASONING)
    fresh = [len(s.difference(*steps[max(0, i - 3) : i])) / len(s) for i, s in enumerate(steps) if i]
    return {"step_novelty": sum(fresh) / len(fresh), "stalled_step_ratio": sum(f < 0.25 for f in fresh) / len(fresh)}


def _pass(wanted: tuple[str, ...], only: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = dict.fromkeys(wanted)
        marks = [c for c in wanted if c in ARTIFACT]
        by_words = DISTRIBUTIONAL[0] in wanted or marks
        for batch in batches:
            rows = []
            able = batch.column(only).to_pylist() if only else itertools.repeat(True)
            for (_, text), measured in zip(texts_of(batch), able):
                if not measured:
                    rows.append(none)
                    continue
                words = words_of(text) if by_words else []
                row = distributional(text, words) if DISTRIBUTIONAL[0] in wanted else {}
                if REASONING[0] in wanted:
                    row |= reasoning(sentences_of(text))
                if marks:
                    row |= artifacts(text, words, marks)
                rows.append(row)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([r[c] for r in rows], pa.float64()) for c in wanted]], [*batch.schema.names, *wanted])
            give_back()

    return run


def _measured(docs: DataFrame, wanted: tuple[str, ...], only: str | None) -> DataFrame:
    return docs.mapInArrow(_pass(wanted, only), StructType([*docs.schema.fields, *[StructField(c, DoubleType()) for c in wanted]]))


def with_text_signals(docs: DataFrame, families: tuple[str, ...] = ("distributional", "reasoning"), only: str | None = None) -> DataFrame:
    """``docs`` and the distributional, reasoning and artifact signals (M1-M12, R1-R4, A1-A6); null where the column ``only`` is false."""
    kinds = (("distributional", DISTRIBUTIONAL), ("reasoning", REASONING), ("artifact", ARTIFACT))
    return _measured(docs, tuple(c for family, names in kinds if family in families for c in names), only)


def text_signals(docs: DataFrame, families: tuple[str, ...] = ("distributional", "reasoning")) -> DataFrame:
    """doc_id and the distributional and reasoning signals."""
    return with_text_signals(docs.select("doc_id", "text"), families).drop("text")


# --- artifacts (A1-A6) ---------------------------------------------------------------

#: For each phrase pattern, strings of which one stands in whatever it matches, case folded. They
#: only spare the pattern where it cannot match.
_ECHO_SIGNS = (
    ("as an ai",), ("language model",), ("as of my ",), (" cut",), ("able to ",), ("assist with th", "help with th"), ("sorry",), ("i hope th",),
    (" if you have any ", " if you need any "), ("great question",), ("certainly", "absolutely", "sure"), (" to help",),
)
_HEDGE_SIGNS = (
    ("s important ", "s worth ", "s crucial ", "s essential ", "s vital "), ("s worth ",), ("said,",), ("keep in mind",), (" role",), ("in today's ",),
    ("ing landscape", "ing world", "ing field"), (" range of", " array of", " variety of", " spectrum of"), ("in conclusion,", "in summary,", "to summari", "to sum up,"), ("navigat",), ("at the end of the day",), ("when it comes to",),
)


#: Letters that fold to i, s and k in any case: the folded text only tells where a pattern may match.
_FOLDS = str.maketrans("\u0130\u0131\u017f\u212a", "iisk")
_ECHO, _HEDGE = ([(re.compile(p, re.I | re.M), s) for p, s in zip(ps, signs, strict=True)] for ps, signs in ((ASSISTANT_ECHO, _ECHO_SIGNS), (HEDGING, _HEDGE_SIGNS)))
_LOWER_I, _REPEATED, _APOSTROPHES, _BOLD = map(re.compile, (LOWER_I, REPEATED_PUNCTUATION, APOSTROPHES, BOLD_LEAD))
_OPENER = re.compile(r"[ \t\"'*#>\-•]*([A-Za-z]+)")
_LEXICON, _INFORMAL, _TRANSITIONS = frozenset(LEXICON), frozenset(INFORMAL), frozenset(TRANSITIONS)


def _matches(text: str, folded: str, patterns: list) -> int:
    return sum(sum(1 for _ in p.finditer(text)) for p, signs in patterns if any(map(folded.__contains__, signs)))


def artifacts(text: str, words: list[str], wanted: Sequence[str] = ARTIFACT) -> dict[str, float | None]:
    """A1-A6, of them the ``wanted`` ones; null without words (A5: sentences, A6: five lines)."""
    out: dict[str, float | None] = dict.fromkeys(wanted)
    n = len(words)
    if not n:
        return out
    if "assistant_echo_rate" in out or "hedging_rate" in out:
        folded = (text if _latin(text) else text.translate(_FOLDS)).lower()
        out |= {k: _matches(text, folded, ps) * 1000.0 / n for k, ps in (("assistant_echo_rate", _ECHO), ("hedging_rate", _HEDGE)) if k in out}
    if "llm_lexicon_rate" in out:
        out["llm_lexicon_rate"] = sum(map(_LEXICON.__contains__, words)) * 1000.0 / n
    if "human_noise_rate" in out:
        noise = sum(sum(1 for _ in p.finditer(text)) for p in (_LOWER_I, _REPEATED)) + sum(map(_INFORMAL.__contains__, words))
        out["human_noise_rate"] = (noise + (len(set(_APOSTROPHES.findall(text))) > 1)) * 1000.0 / n
    if "transition_rate" in out and (sentences := sentences_of(text)):
        opened = (_OPENER.match(x) for x in sentences)
        out["transition_rate"] = sum(m is not None and m[1].lower() in _TRANSITIONS for m in opened) / len(sentences)
    if "bold_lead_rate" in out:
        lines = [x for x in map(str.rstrip, text.splitlines()) if x]
        if len(lines) >= 5:
            out["bold_lead_rate"] = sum("**" in x and _BOLD.search(x) is not None for x in lines) / len(lines)
    return out


def artifact_signals(docs: DataFrame, wanted: Sequence[str] = ARTIFACT) -> DataFrame:
    """doc_id and the artifact signals, or the ``wanted`` ones."""
    return _measured(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), tuple(wanted), None).drop("text")
