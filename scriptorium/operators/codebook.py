"""The codebook of all well-formed syllables: onset x nucleus x tone x nasal coda."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.translit import NKO_TO_IPA, as_map

# Fixed values, in the codebook's order.
VOWELS = "ߊߋߌߍߎߏߐ"
CONSONANTS = "ߒߓߔߕߖߗߘߙߚߛߜߝߞߟߠߡߢߣߤߥߦߧߨ"
TONES = "߫߬߭߮߯"
CODAS = "߲߳"


def codebook(spark: SparkSession) -> DataFrame:
    """Rows (syllable, onset, nucleus, tone, coda, pattern, ipa): 7 x 18 x 24 of them.

    A cross join of four literal tables of fixed size; their rows are generated."""

    def dim(name: str, chars: str, empty: bool):
        values = ([""] if empty else []) + list(chars)
        return spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))

    rows = dim("onset", CONSONANTS, True).crossJoin(dim("nucleus", VOWELS, False)).crossJoin(dim("tone", TONES, True)).crossJoin(dim("coda", CODAS, True))
    m = as_map({c: NKO_TO_IPA[c] for c in CONSONANTS + VOWELS + TONES})
    pattern = F.concat(F.when(F.col("onset") != "", "C").otherwise(""), F.lit("V"), F.when(F.col("coda") != "", "N").otherwise(""))
    ipa = F.concat(
        F.when(F.col("onset") != "", F.try_element_at(m, F.col("onset"))).otherwise(""), F.try_element_at(m, F.col("nucleus")),
        F.when(F.col("coda") != "", "̃").when(F.col("tone") != "", F.try_element_at(m, F.col("tone"))).otherwise(""),
    )
    return rows.select(F.concat("onset", "nucleus", "tone", "coda").alias("syllable"), "onset", "nucleus", "tone", "coda", pattern.alias("pattern"), ipa.alias("ipa"))


def _values(chars: str, empty: bool) -> str:
    return ", ".join(f"('{c}')" for c in ([""] if empty else []) + list(chars))


_MAP = "MAP {" + ", ".join(f"'{c}': '{NKO_TO_IPA[c]}'" for c in CONSONANTS + VOWELS + TONES) + "}"
SQL = f"""SELECT onset || nucleus || tone || coda AS syllable, onset, nucleus, tone, coda,
  CASE WHEN onset <> '' THEN 'C' ELSE '' END || 'V' || CASE WHEN coda <> '' THEN 'N' ELSE '' END AS pattern,
  CASE WHEN onset <> '' THEN {_MAP}[onset] ELSE '' END || {_MAP}[nucleus] || CASE WHEN coda <> '' THEN chr(771) WHEN tone <> '' THEN {_MAP}[tone] ELSE '' END AS ipa
  FROM (VALUES {_values(CONSONANTS, True)}) o(onset), (VALUES {_values(VOWELS, False)}) v(nucleus), (VALUES {_values(TONES, True)}) t(tone), (VALUES {_values(CODAS, True)}) c(coda)"""
