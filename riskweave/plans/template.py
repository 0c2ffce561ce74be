"""Parameterised insert-selects (S18): a SQL text with named parameter markers, bound by Spark.

A template names tables as ``IDENTIFIER(:source)`` and values as markers. Nothing is pasted into its text: Spark's parser binds the
markers, so a value can neither end a string nor add a clause. What a template may use:

``:source`` ``:destination`` ``:feature_name`` ``:feature_version`` ``:dependent_feature_id`` ``:min_day`` ``:max_day`` and ``:stamp``

``:stamp`` is the as-of time (D 23:59:59) and must occur exactly once; functions that read the clock are refused, since a
rebuilt day must not depend on when it is rebuilt. The registry's filter condition applies to the source, as a DataFrame
predicate, before the template sees it.
"""

from __future__ import annotations

import datetime as _dt
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave import constants as K

MARKERS = ("source", "destination", "feature_name", "feature_version", "dependent_feature_id", "min_day", "max_day", "stamp")
#: Functions and keywords that read the clock.
CLOCK = ("current_timestamp", "current_date", "current_time", "localtimestamp", "now", "curdate", "unix_timestamp", "to_unix_timestamp")
_QUIET = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)


class TemplateError(ValueError):
    """A template that must not run."""


def check_template(text: str) -> None:
    """Refuse a text with another number of ``:stamp`` than one, unknown markers, or a function that reads the clock."""
    code = _QUIET.sub(" ", text)
    used = re.findall(r"(?<![:\w]):([A-Za-z_]\w*)", code)
    unknown = sorted(set(used) - set(MARKERS))
    if unknown:
        raise TemplateError(f"markers that nothing fills: {unknown}")
    if used.count("stamp") != 1:
        raise TemplateError(f"expected exactly one :stamp, found {used.count('stamp')}")
    clock = re.search(rf"(?i)(?<![\w.]):?({'|'.join(CLOCK)})\b(?!\s*\(\s*[^)\s])", code)
    if clock:
        raise TemplateError(f"depends on the clock: {clock.group(1)}")


def run_template(spark: SparkSession, text: str, source: DataFrame, destination: DataFrame, feature_name: str, feature_version, day: _dt.date,
                 dependent_feature_id: str = "", category: str | None = None, filter_condition: str | None = None) -> DataFrame:
    """The rows a template gives for day D. P5: the input days are [D, D+1) for work and [D-1, D) for other categories; P6: the filter
    is applied to the source."""
    check_template(text)
    first = day + _dt.timedelta(days=K.CATEGORY_INPUT_DAY_OFFSET.get(category, -1))
    if filter_condition and filter_condition.strip():
        source = source.where(F.expr(filter_condition))
    names = {}
    for role, frame in (("source", source), ("destination", destination)):
        names[role] = f"template_{role}_{uuid.uuid4().hex}"
        frame.createOrReplaceTempView(names[role])
    values = {**names, "feature_name": feature_name, "feature_version": str(feature_version), "dependent_feature_id": dependent_feature_id,
              "min_day": first, "max_day": first + _dt.timedelta(days=1), "stamp": f"{day} 23:59:59"}
    used = set(re.findall(r"(?<![:\w]):([A-Za-z_]\w*)", _QUIET.sub(" ", text)))
    return spark.sql(text, args={k: v for k, v in values.items() if k in used})


#: One day of a running total: the day's newest value of each entity plus its newest total before D.
CUMULATIVE_DAY = """
WITH daily AS (
  SELECT entity_id, max_by(feature_value, struct(timestamp, feature_value)) AS v FROM IDENTIFIER(:source)
  WHERE feature_id = :dependent_feature_id AND timestamp >= :min_day AND timestamp < :max_day AND entity_id IS NOT NULL GROUP BY entity_id),
prior AS (
  SELECT entity_id, max_by(feature_value, struct(timestamp, feature_value)) AS total FROM IDENTIFIER(:destination)
  WHERE feature_id = concat(:feature_name, '_v', :feature_version) AND timestamp < :max_day AND feature_value IS NOT NULL GROUP BY entity_id)
SELECT d.entity_id, concat(:feature_name, '_v', :feature_version) AS feature_id, :feature_name AS feature_name, :feature_version AS feature_version,
       coalesce(p.total, 0D) + coalesce(d.v, 0D) AS feature_value, CAST(:stamp AS TIMESTAMP_NTZ) AS timestamp, '' AS comments
FROM daily d LEFT JOIN prior p ON p.entity_id = d.entity_id
"""
