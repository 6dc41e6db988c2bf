"""Names as columns: labels, collection names, binomials."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_label(c: Column | str) -> Column:
    """Blanks become underscores before anything is stripped."""
    return F.btrim(F.lower(F.replace(F.col(c) if isinstance(c, str) else c, F.lit(" "), F.lit("_"))), F.lit("\t\n\r"))


#: Every letter that canonical decomposition leaves one ASCII letter of, and that letter; other characters outside ASCII go.
_FOLDS = {chr(c): base for c in range(0x80, 0x3000) if len(base := unicodedata.normalize("NFD", chr(c)).encode("ascii", "ignore").decode()) == 1}
MARKED, BARE = "".join(_FOLDS), "".join(_FOLDS.values())

# Vernacular names of one source, names of local use, and corrected spellings.
DIALECT = {
    "brzoza": "betula pendula", "buk": "fagus sylvatica", "dab": "quercus robur", "grab": "carpinus betulus", "jawor": "acer pseudoplatanus",
    "jesion": "fraxinus excelsior", "jodla": "abies alba", "lipa": "tilia cordata", "modrzew": "larix decidua", "olsza": "alnus glutinosa",
    "sosna": "pinus sylvestris", "swierk": "picea abies", "wiazy": "ulmus glabra", "wierzba": "salix alba",
}
LOCAL = {"nogal cafetero": "cordia alliodora", "cedro costeno": "cedrela odorata"}
SPELLING = {
    "bertholethia excelsa": "bertholletia excelsa", "grevilea robusta": "grevillea robusta", "cedrelinga catenaeformis": "cedrelinga cateniformis",
    "cupresus lusitanica": "cupressus lusitanica", "cinnamomum czmphora": "cinnamomum camphora",
}


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def standard_name(c: Column) -> Column:
    """Lower case, marks and underscores gone, a leading number dropped."""
    plain = F.regexp_replace(F.translate(stripped(F.lower(c)), MARKED, BARE), r"[^\x00-\x7F]", "")
    return stripped(F.regexp_replace(F.translate(plain, "_", " "), r"^\d+-?", ""))


def replaced(c: Column, pairs: dict[str, str]) -> Column:
    """Another name where the map has one."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)), c), c)


def without_authority(c: Column) -> Column:
    """genus epithet, with `var. x` or `subsp. x` where it follows; else the first two words; lower case."""
    name = F.lower(stripped(c))
    ranked = r"^(\w+)\s+(\w+)\s+(var\.|subsp\.)\s+(\w+)"
    full = F.array_join(F.array(*(F.regexp_extract(name, ranked, i) for i in range(1, 5))), " ")
    return F.when(name.rlike(ranked), full).otherwise(F.array_join(F.slice(F.split(name, r"\s+"), 1, 2), " "))


def variant(c: Column) -> Column:
    """struct(query, variant): what leaves the species open, `genus sp. 2`, and what counts specimens, `genus species 3`, apart."""
    opened, counted = r"(?i)^(\w+)\s+spp?\.?\s*(\d*)$", r"^(\w+\s+\w+)\s+(\d+)$"
    part = lambda query, kind: F.struct(query.alias("query"), kind.alias("variant"))
    number = F.regexp_extract(c, opened, 2)
    open_ = part(F.concat(F.regexp_extract(c, opened, 1), F.lit(" sp")), F.when(number == "", "spp.").otherwise(F.concat(F.lit("spp. "), number)))
    specimen = part(F.regexp_extract(c, counted, 1), F.concat(F.lit("specimen "), F.regexp_extract(c, counted, 2)))
    return F.when(c.rlike(opened), open_).when(c.rlike(counted), specimen).otherwise(part(c, F.lit("")))


def preprocessed(df: DataFrame, name: Column, vernacular: Column) -> DataFrame:
    """df with query, variant, std: standardised, out of the vernacular where the source uses it, its author, local name and spelling mended."""
    out = df.withColumn("std", standard_name(name))
    out = out.withColumn("std", without_authority(F.when(vernacular, replaced(F.col("std"), DIALECT)).otherwise(F.col("std"))))
    out = out.withColumn("std", replaced(replaced(F.col("std"), LOCAL), SPELLING)).withColumn("__variant", variant(F.col("std")))
    return out.withColumns({"query": F.col("__variant.query"), "variant": F.col("__variant.variant")}).drop("__variant")


def binomial(accepted: Column, query: Column) -> Column:
    """The first two words; `genus sp.` where the query leaves the species open; '' where nothing was accepted."""
    words = F.split(F.trim(F.lower(accepted)), r"\s+")
    return F.when(accepted.isNull(), F.lit("")).when(query.rlike(r" spp?\.?$"), F.concat(words[0], F.lit(" sp."))).otherwise(F.array_join(F.slice(words, 1, 2), " "))


def code(c: Column) -> Column:
    """present 1, absent 0, variable a half, else null."""
    value = F.lower(F.trim(c))
    return F.when(value == "p", 1.0).when(value == "a", 0.0).when(value == "v", 0.5)


def rounded(c: Column) -> Column:
    return F.when(c <= 0.25, 0.0).when(c >= 0.75, 1.0).when(c.isNotNull(), 0.5)
