"""Name lists from raw entities: cleaning, and dropping names that mean something else.

Input tables: entities (id, names array, sitelinks, markets array), places (id, names, bare,
population) and common words (lang, word). All steps are expressions and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits, and places that a company's name may collide with.
LONGEST_NAME, WELL_KNOWN, BIG_CITY = 120, 40, 1_000_000
PLACE_WORDS = [
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware", "Florida", "Georgia", "Hawaii", "Idaho",
    "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky", "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan", "Minnesota", "Mississippi",
    "Missouri", "Montana", "Nebraska", "Nevada", "Ohio", "Oklahoma", "Oregon", "Pennsylvania", "Tennessee", "Texas", "Utah", "Vermont", "Virginia",
    "Washington", "Wisconsin", "Wyoming", "America", "Canada", "Mexico", "England", "Scotland", "Wales", "Ireland", "France", "Belgium",
    "Switzerland", "Spain", "Germany", "Italy", "Portugal", "Netherlands", "Austria", "Australia", "China", "Japan", "India", "Brazil", "Argentina",
    "Chile", "Colombia", "Peru", "Morocco", "Algeria", "Tunisia", "Senegal", "Europe", "Africa", "Asia", "Canadá", "México", "Francia", "Bélgica",
    "Suiza", "España", "Alemania", "Italia", "Irlanda", "Inglaterra", "Escocia", "Europa", "Allemagne", "Espagne", "Italie", "Belgique", "Suisse",
    "Angleterre", "Écosse", "Irlande", "Mexique", "Brésil", "Maroc", "Algérie", "Tunisie", "Sénégal", "Chine", "Japon", "Inde", "Afrique",
]
CITY_ENDINGS = ["市", "省", "自治区", "自治區", "特别行政区", "特別行政區"]


def clean(name: Column) -> Column:
    """Without a disambiguating tail in brackets."""
    return F.trim(F.regexp_replace(name, r"\s*[（(][^()（）]*[)）]\s*$", ""))


def strip_edges(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)\A[\W_]+|[\W_]+\z", "")


def fold(name: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(name), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def shape_ok(name: Column, sitelinks: Column) -> Column:
    """Whether a name may stand in a list as far as its own form tells."""
    raw, n = name, strip_edges(name)
    cjk = n.rlike("[㐀-鿿]")
    one_word = F.size(F.regexp_extract_all(n, F.lit(r"\p{L}+"), F.lit(0))) == 1
    latin = (F.length(n) >= 3) & n.rlike(r"\p{L}") & ~n.isin(PLACE_WORDS) & ~n.rlike(r"\A\S+\.[a-z]{2,}\z") & (n != F.lower(n)) & ~(one_word & (n == F.upper(n)) & (F.length(n) <= 3))
    return (raw != "") & ~raw.rlike("[:/]") & (F.length(raw) <= LONGEST_NAME) & (n != "") & F.when(cjk, (F.length(n) >= 2) & ((F.length(n) >= 3) | (sitelinks >= WELL_KNOWN))).otherwise(latin)


def place_names(places: DataFrame, common: DataFrame) -> DataFrame:
    """(id, name) of places, with bare city names where they are safe."""
    n = places.select("id", "bare", "population", F.explode("names").alias("raw")).withColumn("name", clean(F.col("raw")))
    big = F.col("population") >= BIG_CITY
    whole = (F.col("bare") == "always") | ((F.col("bare") == "big") & big)
    cut = F.array(*(F.when(F.col("name").endswith(e) & (F.length("name") - len(e) >= 2) & whole, F.left("name", F.length("name") - len(e))) for e in CITY_ENDINGS))
    small = F.when((F.col("bare") == "big") & ~whole & F.col("name").endswith("市") & (F.length("name") >= 4), F.left("name", F.length("name") - 1))
    every = n.select("id", F.explode(F.concat(F.array("name"), cut, F.array(small))).alias("name")).filter("name is not null").distinct()
    zh = common.filter("lang = 'zh'").select(F.col("word").alias("name")).distinct()
    return every.filter((F.length("name") >= 2) & ~F.col("name").contains(":")).join(zh, "name", "left_anti").select("id", "name")


def company_names(entities: DataFrame, places: DataFrame, common: DataFrame) -> DataFrame:
    """(id, name) of companies that are neither words, places nor domain names."""
    n = entities.select("id", "sitelinks", F.explode("names").alias("raw")).withColumn("name", clean(F.col("raw"))).distinct()
    n = n.filter(shape_ok(F.col("name"), F.col("sitelinks"))).withColumn("bare", strip_edges(F.col("name"))).withColumn("folded", fold(F.col("name")))
    n = n.join(places.select(F.col("name").alias("bare")).distinct(), "bare", "left_anti")
    n = n.join(common.filter("lang = 'zh'").select(F.col("word").alias("bare")).distinct(), "bare", "left_anti")
    words = common.filter("lang in ('en', 'fr', 'es')").select(F.col("word").alias("folded")).distinct().withColumn("is_word", F.lit(True))
    single = F.size(F.regexp_extract_all("name", F.lit(r"\p{L}+"), F.lit(0))) == 1
    return n.join(words, "folded", "left").filter(~(single & F.coalesce("is_word", F.lit(False)) & ~F.col("bare").rlike("[㐀-鿿]"))).select("id", "name")


def as_lists(names: DataFrame, kind: str) -> list[tuple[str, list[str]]]:
    """A list for `detect(lists=...)`. Lists are reference data and must fit the driver."""
    return [(kind, sorted(r.name for r in names.select("name").distinct().collect()))]
