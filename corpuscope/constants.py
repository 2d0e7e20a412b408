"""Values that results depend on."""

from __future__ import annotations

# --- fixed values: word lists, patterns, thresholds and names that results must agree on ---

FAMILIES = ("distributional", "surprisal", "artifact", "reasoning")
TIERS = ("LIKELY_SYNTHETIC", "SUSPECT", "CLEAN", "UNSCORED")

TEXT_FIELDS = ("text", "content", "raw_content", "body", "document", "page_content")
ID_FIELDS = ("doc_id", "id", "_id", "url", "uri", "path")
LABEL_FIELDS = ("label", "origin", "source_type", "class")
JSONL_SUFFIXES = (".jsonl", ".ndjson", ".jsonl.gz", ".ndjson.gz", ".json.gz")
TEXT_SUFFIXES = (".txt", ".md", ".rst", ".text")

ABBREVIATIONS = """mr mrs ms dr prof sr jr st vs etc al fig eq no approx dept est inc ltd co jan feb mar apr jun jul
aug sep sept oct nov dec i.e e.g cf ca vol pp ed""".split()

ENGLISH_WORDS = """the of and to in is it that was for on are as with be by at this have from or an but not they which
you he she we his her their there were been has had will would can could should may might must shall do does did if
then than so what when where who whom whose how why all any each other some such no nor only own same too very just
into about over after before between through during under above below up down out off again further once here more
most both few these those its our your my me him them us am being having doing""".split()

FOREIGN_WORDS = {
    "French": "le la les des du un une est et que qui dans pour pas sur avec ce cette il elle sont au aux vous nous ou mais leur ses son sa par plus être été",
    "German": "der die das und ist nicht mit den dem des ein eine einen zu von sich auf für auch es sie wir ich werden wird sind oder bei aus nach wie kann",
    "Spanish": "el los las del que en es por con para una su se lo como más pero sus al esta este son puede ser",
    "Italian": "il di che è la per un una con non sono del della le gli dei delle questo nel alla essere può anche",
    "Portuguese": "os da do das dos que é em um uma para com não se ao na no mais pode ser seu sua",
    "Dutch": "de het een en van dat op te zijn niet met voor er ook worden wordt kan aan bij uit naar deze",
    "Swedish": "och att det som en på är av för med till den inte har om ett kan de du",
    "Danish/Norwegian": "og at det som en på er af av for med til den ikke har om et kan de du",
    "Finnish": "ja on ei se että tai kun joka mutta voi ovat sinun tämä",
    "Polish": "w na nie się że do jest to jak lub oraz może są ten",
    "Czech/Slovak": "na je se sa že do nebo alebo jako ako ve vo pro pre to být byť může môže",
    "Croatian/Slovenian": "na je se da za od ili ali kao kot može lahko su so in",
    "Romanian": "și în de la cu că pe nu este sau pentru un care sunt",
    "Catalan": "el la els les de que en es per amb no un una del al són pot",
    "Hungarian": "az és hogy nem egy is van meg csak vagy ha de mint",
    "Turkish": "ve bir bu da de için ile ne değil olarak veya daha çok",
    "Indonesian/Malay": "dan yang di untuk dengan ini itu dari tidak ke atau pada dapat anda",
    "Vietnamese": "và của có là được không cho các những một này với để trong",
}

ASSISTANT_ECHO = (
    r"\bas an ai\b(?:\s+(?:language\s+)?(?:model|assistant))?",
    r"\bas a (?:large )?language model\b",
    r"\bas of my (?:last|latest|most recent) (?:knowledge )?(?:update|training)",
    r"\bmy (?:knowledge|training)(?:\s+data)? cut-?off\b",
    r"\bi(?:'m| am) (?:not able|unable) to (?:browse|access|provide|assist)",
    r"\bi (?:cannot|can't|can not) (?:assist|help) with (?:that|this)",
    r"\bi(?:'m| am) sorry,? but i (?:cannot|can't|am unable)",
    r"\bi hope (?:this|that) helps\b",
    r"\b(?:let me know|feel free to (?:ask|reach out)) if you (?:have|need) any (?:other|further|more|additional) (?:questions|help)",
    r"\bgreat question\b",
    r"^\s*(?:certainly|absolutely|sure)[!,]\s+here(?:'s| is)",
    r"\bi(?:'d| would) be (?:happy|glad) to help\b",
)
HEDGING = (
    r"\bit(?:'s| is) (?:important|worth|crucial|essential|vital) (?:to )?(?:note|noting|remember|mention|consider|understand|recogni[sz]e|highlight)",
    r"\bit(?:'s| is) worth (?:noting|mentioning|highlighting)",
    r"\bthat (?:being )?said,",
    r"\bkeep in mind that\b",
    r"\b(?:plays?|played|playing) an? (?:crucial|vital|pivotal|key|significant|essential|important) role\b",
    r"\bin today's (?:fast-paced|digital|rapidly (?:evolving|changing)|modern|ever-changing|interconnected)",
    r"\b(?:rapidly|ever-)(?:evolving|changing) (?:landscape|world|field)",
    r"\ban? (?:wide|diverse|broad|rich) (?:range|array|variety|spectrum) of\b",
    r"\b(?:in conclusion|in summary|to summari[sz]e|to sum up),",
    r"\bnavigat(?:e|ing) the (?:complexities|challenges|intricacies|landscape)",
    r"\bat the end of the day\b",
    r"\bwhen it comes to\b",
)
LEXICON = """delve delves delved delving tapestry tapestries multifaceted testament pivotal showcase showcases showcased
showcasing meticulous meticulously embark embarks embarked embarking fostering holistic paramount bustling commendable
unwavering groundbreaking transformative invaluable elevate elevates elevating resonate resonates resonating unleash
unleashing synergy synergies""".split()
TRANSITIONS = """moreover furthermore additionally consequently ultimately notably importantly overall interestingly
essentially crucially indeed subsequently""".split()
BOLD_LEAD = r"^\s*(?:[-*+•]\s+|\d+[.)]\s+)?\*\*[^*\n]{1,80}(?::\*\*|\*\*:)"
LOWER_I = (
    r"(?<![A-Za-z0-9_.])i(?:'m|'ve|'d|'ll|’m|’ve|’d|’ll)(?![A-Za-z])"
    r"|(?<![A-Za-z0-9_.(])i (?:am|was|think|have|had|dont|don't|can|cant|can't|will|would|just|really|guess|know|want|need|got|feel|did|mean|said|tried|found|wanted|thought|love|hate|like|use|used|see|saw)\b"
)
REPEATED_PUNCTUATION = r"(?<=[A-Za-z])[!?]{2,}"
APOSTROPHES = r"[A-Za-z](['’])[A-Za-z]"
INFORMAL = """lol lmao tbh idk imo imho btw gonna wanna kinda sorta dunno gotta yeah yep nope haha hahaha ugh omg thx
pls plz""".split()

STOPWORDS = """a about above after again against all also am an and any are as at be because been before being below
between both but by can could did do does doing done down during each either else ever every few for from further had
has have having he her here hers herself him himself his how however i if in into is it its itself just let lets like
may me might more most much must my myself neither no nor not now of off on once only or other our ours ourselves out
over own per quite rather same shall she should since so some still such than that the their theirs them themselves
then there these they this those though through thus to too under until up upon us very via was we were what when where
whether which while who whom whose why will with within without would yet you your yours yourself yourselves one two
first second third next finally step therefore hence so let's we'll it's that's there's here's""".split()
SUFFIXES = ("ations", "ation", "ments", "ment", "ings", "ing", "ies", "ied", "ness", "edly", "ed", "es", "ly", "s")

MIN_WORDS = 50
MIN_LATIN, MIN_FOREIGN, FOREIGN_TO_ENGLISH = 0.8, 0.03, 1.5
MIN_COVERAGE_SPREAD, MIN_COVERAGE_SENTENCES = 0.70, 0.85
LM_DISCOUNT = 0.75
Z_CAP, PRECISION, MIN_BIN, MAX_BINS, MAD_SCALE = 6.0, 6, 50, 20, 1.4826
FISHER_MISSING = 2.0
ALPHAS = (0.0025, 0.005, 0.0075, 0.01, 0.015, 0.02, 0.025, 0.03, 0.04, 0.05, 0.06, 0.08, 0.10)
QUANTILES = 201

#: signal: (family, direction, what it measures)
SIGNALS = {
    "unigram_entropy": ("distributional", -1, "entropy of the word distribution, bits"),
    "normalized_entropy": ("distributional", -1, "entropy over its maximum"),
    "hapax_ratio": ("distributional", -1, "share of word types that occur once"),
    "yules_k": ("distributional", 1, "Yule's K, repetition of word types"),
    "conditional_bigram_entropy": ("distributional", -1, "branching after words seen more than once, bits"),
    "mtld": ("distributional", -1, "lexical diversity, words per factor, both directions"),
    "zipf_slope": ("distributional", -1, "slope of log frequency on log rank"),
    "spectrum_slope": ("distributional", 1, "slope of the frequency spectrum"),
    "heaps_beta": ("distributional", -1, "exponent of vocabulary growth"),
    "repetition_4gram": ("distributional", 1, "share of repeated token 4-grams"),
    "repetition_8gram": ("distributional", 1, "share of repeated token 8-grams"),
    "compression_ratio": ("distributional", -1, "compressed over plain bytes"),
    "mean_surprisal": ("surprisal", -1, "mean bits per word given the rest of the corpus"),
    "predictable_run_fraction": ("surprisal", 1, "share of words in long predictable runs"),
    "surprisal_std": ("surprisal", -1, "spread of bits per word"),
    "sentence_surprisal_std": ("surprisal", -1, "spread of mean bits per sentence"),
    "assistant_echo_rate": ("artifact", 1, "chat-assistant phrases per 1,000 words"),
    "hedging_rate": ("artifact", 1, "formulaic hedges per 1,000 words"),
    "llm_lexicon_rate": ("artifact", 1, "words overused by language models per 1,000 words"),
    "human_noise_rate": ("artifact", -1, "marks of hasty typing per 1,000 words"),
    "transition_rate": ("artifact", 1, "share of sentences that open with a discourse adverb"),
    "bold_lead_rate": ("artifact", 1, "share of lines that open with a bold label"),
    "step_novelty": ("reasoning", -1, "share of a step's content that the last three lack"),
    "stalled_step_ratio": ("reasoning", 1, "share of steps that add almost nothing"),
}
# --- end of fixed values ---

#: How families are judged: both tails and the mean, or one tail and the strongest signal.
TWO_SIDED = {"distributional": True, "surprisal": True, "reasoning": True, "artifact": False}


def english() -> set[str]:
    return {w for w in ENGLISH_WORDS if len(w) > 1}


def foreign() -> dict[str, list[str]]:
    """Per language, its words of two letters or more that are not English."""
    known = english()
    return {lang: list(dict.fromkeys(w for w in words.split() if len(w) > 1 and w not in known)) for lang, words in FOREIGN_WORDS.items()}
