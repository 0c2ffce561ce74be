"""Feature registry: lookups (S3), the PROD scoring-feature list (S4) and parsing of the
``dependent_features`` mini-language (F12) as one column-expression job over the whole registry --
no per-row Python.

Text shape: ``[k:v, k:[a, b], k:{a:1, b:2}, 'k:text, with commas', ...]``. Exactly one outer bracket pair is stripped (Q19
decision). Items are cut at commas outside brackets, braces and quoted items: a fold over the commas, brackets, quotes and
backslashes carries the depth of brackets and the open quote. A quote counts where an item begins; inside it a backslash takes the next character as it is.
In a text with a quote that never closes, quotes are ordinary characters. Quotes around an item go, items
without ':' are skipped, and each value is typed: 'True'/'False' -> bool, '[..]' -> list (every comma splits), '{..}' -> map,
integer text -> int, anything else text (decimals are cast where used). NULL and empty texts have no items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INT = r"^[+-]?\d+$"
_MARKS = r"[,\[\]{}'\"\\]"
_PLAIN = r"[^,\[\]{}'\"\\]*"
_STATE = "struct<depth:int,quote:string,fresh:boolean,escaped:boolean,at:int,cuts:array<int>>"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _marks(text: Column) -> Column:
    """A text's marks (commas, brackets, quotes, backslashes), each with the number of characters up to the next one and
    whether these are blank. Other characters change nothing but the place and whether an item has begun."""
    return F.transform(F.regexp_extract_all(text, F.lit(_MARKS + _PLAIN), F.lit(0)), lambda t: F.struct(
        F.substr(t, F.lit(1), F.lit(1)).alias("c"), F.length(t).alias("n"), (~F.substr(t, F.lit(2)).rlike(r"\S")).alias("blank")))


def _step(quotes: bool):
    def step(s: Column, m: Column) -> Column:
        c = m["c"]
        inside = s["quote"] != ""
        comma = ~inside & (c == ",") & (s["depth"] == 0)
        opens = ~inside & s["fresh"] & c.isin("'", '"') if quotes else F.lit(False)
        closes = inside & ~s["escaped"] & (c == s["quote"])
        depth = (F.when(inside | opens, s["depth"]).when(c.isin("[", "{"), s["depth"] + 1)
                  .when(c.isin("]", "}"), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"]))
        return F.struct(
            depth.alias("depth"), F.when(opens, c).when(closes, F.lit("")).otherwise(s["quote"]).alias("quote"),
            (comma & m["blank"]).alias("fresh"), (inside & ~s["escaped"] & (c == "\\") & (m["n"] == 1)).alias("escaped"),
            (s["at"] + m["n"]).alias("at"), F.when(comma, F.concat(s["cuts"], F.array(s["at"]))).otherwise(s["cuts"]).alias("cuts"))

    return step


def _folded(text: Column, marks: Column, quotes: bool) -> Column:
    head = F.regexp_extract(text, "^" + _PLAIN, 0)
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("quote"), (~head.rlike(r"\S")).alias("fresh"), F.lit(False).alias("escaped"),
                     (F.length(head) + 1).alias("at"), F.array().cast("array<int>").alias("cuts")).cast(_STATE)
    return F.aggregate(marks, start, _step(quotes))


def _pieces(text: Column, cuts: Column) -> Column:
    """The text between cuts (1-based places of single characters)."""
    return _bound(F.concat(F.array(F.lit(0)), cuts, F.array(F.length(text) + 1)), lambda edges: F.transform(
        F.sequence(F.lit(0), F.size(edges) - 2), lambda i: F.substr(text, F.get(edges, i) + 1, F.get(edges, i + 1) - F.get(edges, i) - 1)))


def _top_level(text: Column) -> Column:
    """The items of a text, cut at its top-level commas: at all of them where nothing opens a bracket or a quote."""
    def cuts(marks: Column) -> Column:
        return _bound(_folded(text, marks, True), lambda s: F.when(s["quote"] == "", s["cuts"]).otherwise(_folded(text, marks, False)["cuts"]))

    return (F.when(F.length(text) > 0, F.when(~text.rlike(r"[\[{'\"]"), F.split(text, ",")).otherwise(_bound(_bound(_marks(text), cuts), lambda c: _pieces(text, c))))
             .otherwise(F.array().cast("array<string>")))


def _strip_quotes(c):
    """Without the quotes around it; a whole quoted item is read with its escapes."""
    t = F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))
    whole = t.rlike(r"(?s)^'(?:[^'\\]++|\\.)*+'$") | t.rlike(r'(?s)^"(?:[^"\\]++|\\.)*+"$')
    return F.when(~c.rlike("['\"]"), t).when(whole, F.regexp_replace(F.substr(t, F.lit(2), F.length(t) - 2), r"\\(.)", "$1")).otherwise(
        F.regexp_replace(t, r"^['\"]+|['\"]+$", ""))


def _spread(registry: DataFrame) -> DataFrame:
    """The rows dealt evenly over all cores: a registry is a small file that is read in one task, and its texts are costly to parse."""
    spark = registry.sparkSession
    return registry.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def parse_dependent_features(registry: DataFrame, key: str = "feature_id", text_col: str = "dependent_features") -> DataFrame:
    """-> (key, pos, param, kind, value_text, list_value, map_value): one row per parsed item."""
    text = F.regexp_replace(F.trim(F.col(text_col)), r"(?s)^\[(.*)\]$", "$1")
    # the fold reads each text once: cut texts are columns of their own, not expressions inside others
    rows = _spread(registry.select(F.col(key), F.col(text_col)))
    items = rows.select(F.col(key), text.alias("text")).select(key, F.posexplode(_top_level(F.col("text"))).alias("pos", "item"))
    items = items.withColumn("item", _strip_quotes(F.col("item"))).where(F.col("item").contains(":"))
    k = F.trim(F.substring_index("item", ":", 1))
    v = F.trim(F.expr("substr(item, instr(item, ':') + 1)"))
    items = items.select(key, "pos", k.alias("param"), v.alias("v"))
    is_list = F.col("v").startswith("[") & F.col("v").endswith("]")
    is_map = F.col("v").startswith("{") & F.col("v").endswith("}")
    items = items.withColumn("body", F.when(is_list | is_map, F.expr("substr(v, 2, length(v) - 2)")))
    kind = (F.when(F.col("v").isin("True", "False"), F.lit("bool")).when(is_list, F.lit("list"))
             .when(is_map, F.lit("map")).when(F.col("v").rlike(_INT), F.lit("int")).otherwise(F.lit("text")))
    list_value = F.when(is_list, F.transform(F.split("body", ","), lambda x: F.trim(x)))
    entries = F.when(is_map, F.filter(F.transform(_top_level(F.col("body")), _strip_quotes), lambda x: x.contains(":")))
    items = items.select(key, "pos", "param", kind.alias("kind"), "v", list_value.alias("list_value"), entries.alias("entries"))
    pairs = F.transform("entries", lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_extract(x, r"(?s):(.*)$", 1)).alias("value")))
    items = items.select(key, "pos", "param", "kind", "v", "list_value", pairs.alias("pairs"))
    pairs = F.col("pairs")
    # of a key that is given twice the last value counts
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return items.select(key, "pos", "param", "kind", F.col("v").alias("value_text"), "list_value",
                        F.when(pairs.isNotNull(), F.map_from_entries(last)).alias("map_value"))


def registry_rows(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """S3/O3: for each wanted (feature_name, version) its registry row, with ``n_found`` rows of that name and version: of several
    the first by feature_id counts, of none the row has NULLs. One join for any number of lookups."""
    rows = registry.withColumn("version", F.col("version").cast("string"))
    others = [c for c in rows.columns if c not in ("feature_name", "version")]
    first = rows.groupBy("feature_name", "version").agg(
        F.min_by(F.struct(*others), F.struct("feature_id", *[c for c in others if c != "feature_id" and dict(rows.dtypes)[c] == "string"])).alias("row"),
        F.count(F.lit(1)).alias("n_found"))
    asked = wanted.select("feature_name", F.col("version").cast("string").alias("version")).distinct()
    return asked.join(first, ["feature_name", "version"], "left").select("feature_name", "version", "row.*", F.coalesce("n_found", F.lit(0)).alias("n_found"))


def scoring_features(registry: DataFrame) -> DataFrame:
    """PROD rows whose parameters name a scoring method or a scoring function."""
    t = F.col("dependent_features")
    return registry.where((F.col("status") == F.lit("PROD")) & (t.contains("scoring_method") | t.contains("scoring_function")))
