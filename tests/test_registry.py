"""how the registry's texts are dealt to tasks and cut into items."""

import random

from pyspark.sql import functions as F

from riskweave.sources.registry import _top_level, parse_dependent_features

SCHEMA = "feature_id string, dependent_features string"


def test_one_file_is_parsed_in_many_tasks(spark):
    rows = [(f"f{i}", f"[a:[{i}, b], n:{i}]") for i in range(400)] + [(None, "n:1"), (None, "n:1"), ("f0", None)]
    parsed = parse_dependent_features(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    per_task = [r["count"] for r in parsed.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 802 and len(per_task) > 1
    assert max(per_task) <= 802 // 2


def items_of(text: str) -> list[str]:
    """The rule, one character after another."""
    def cuts(quotes):
        depth, quote, fresh, escaped, out = 0, "", True, False, []
        for at, c in enumerate(text):
            if quote:
                if not escaped and c == quote:
                    quote = ""
                escaped = not escaped and c == "\\"
                fresh = False
            elif quotes and fresh and c in "'\"":
                quote, fresh, escaped = c, False, False
            elif c == "," and depth == 0:
                out.append(at)
                fresh = True
            else:
                depth = depth + 1 if c in "[{" else max(depth - 1, 0) if c in "]}" else depth
                fresh = fresh and c in " \t\n\x0b\f\r"
        return out, quote

    got, left_open = cuts(True)
    edges = [-1, *(cuts(False)[0] if left_open else got), len(text)]
    return [text[a + 1:b] for a, b in zip(edges, edges[1:])] if text else []


def test_items_of_odd_texts(spark):
    r = random.Random(3)
    marks = list(",,,[]{}''\"\"\\\\:  \t\n\x85abé\U0001f600")
    texts = ["", ",", "a,b", "'a\\\\',b", "'a\\',b", " 'x,y' z', w", "\x85'a,b'", "[a,'b,c],d", "]a,b}", "\\,'"]
    texts += ["".join(r.choice(marks) for _ in range(r.randint(1, 30))) for _ in range(2000)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", _top_level(F.col("t")).alias("items")).collect()
    for row in got:
        assert row.items == items_of(texts[row.i]), texts[row.i]
