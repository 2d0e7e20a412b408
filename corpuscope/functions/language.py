"""Language guard (L1-L3): why a text is evidently not English, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import FOREIGN_TO_ENGLISH, MIN_FOREIGN, MIN_LATIN, english, foreign


def _hits(words: Column, listed) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(sorted(listed))))


def latin_share(words: Column) -> Column:
    """L1: share of the words' characters in Latin script; 1 without any."""
    joined = F.array_join(words, "")
    return F.when(F.length(joined) == 0, 1.0).otherwise(F.length(F.regexp_replace(joined, r"[^a-zA-Z\p{IsLatin}ªº]", "")) / F.length(joined))


def english_share(words: Column) -> Column:
    return F.when(F.size(words) > 0, _hits(words, english()) / F.size(words)).otherwise(0.0)


def foreign_share(words: Column) -> Column:
    return F.when(F.size(words) > 0, _hits(words, set().union(*foreign().values())) / F.size(words)).otherwise(0.0)


def best_language(words: Column) -> Column:
    """The language with most hits; the first listed one on ties."""
    ranked = [F.struct(_hits(words, ws).alias("n"), F.lit(-i).alias("place"), F.lit(lang).alias("lang")) for i, (lang, ws) in enumerate(foreign().items())]
    return F.greatest(*ranked)["lang"]


def _code(n: Column, latin: Column, foreign_: Column, english_: Column) -> Column:
    return F.when(n == 0, F.lit(None)).when(latin < MIN_LATIN, F.lit("script")).when((foreign_ >= MIN_FOREIGN) & (foreign_ > FOREIGN_TO_ENGLISH * english_), F.lit("foreign"))


def reason_code(words: Column) -> Column:
    """L2: ``script``, ``foreign``, or null where nothing speaks against English."""
    return _code(F.size(words), latin_share(words), foreign_share(words), english_share(words))


def non_english_reason(words: Column) -> Column:
    """L2 in words; the share in percent and, for function words, the best known language."""
    pct = lambda c: F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))

    def told(s: Column) -> Column:
        code = _code(s["n"], s["latin"], s["foreign"], s["english"])
        return F.when(code == "script", F.concat(F.lit("not English: "), pct(s["latin"]), F.lit(" of its letters are Latin script"))).when(
            code == "foreign",
            F.concat(F.lit("not English: "), pct(s["foreign"]), F.lit(" function words of another language (closest: "), best_language(words), F.lit(") against "), pct(s["english"]), F.lit(" English")),
        )

    # The shares are bound once, as the one element of an array.
    shares = F.struct(F.size(words).alias("n"), latin_share(words).alias("latin"), foreign_share(words).alias("foreign"), english_share(words).alias("english"))
    return F.get(F.transform(F.array(shares), told), F.lit(0))
