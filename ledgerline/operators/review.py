"""Reviews of runs and answers: profiles, differences, sweeps, forms, perturbations, validators, ordered work."""

from __future__ import annotations

import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import scratch
from ..sources.tables import table


def fill_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, filled, empty, missing) for each column, in one pass."""
    text = {c: F.col(c).cast("string") for c in columns}
    counts = [
        F.struct(F.lit(c).alias("field"), F.count_if(F.trim(text[c]) != "").alias("filled"), F.count_if(F.trim(text[c]) == "").alias("empty"), F.count_if(text[c].isNull()).alias("missing")) for c in columns
    ]
    return df.agg(F.array(*counts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def diff_table(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str], breakdowns: list[str]) -> DataFrame:
    """Mean differences b - a of metrics by grouping sets (), (breakdown), ...; pairs with a missing side are left out by metric."""
    left = a.select(*keys, *breakdowns, *(F.col(m).alias(f"_{m}") for m in metrics))
    met = left.join(b.select(*keys, *metrics), keys)
    sets = ", ".join(["()", *(f"({x})" for x in breakdowns)])
    means = ", ".join(f"round(avg({m} - _{m}), 6) as {m}, count({m} - _{m}) as n_{m}" for m in metrics)
    return met.sparkSession.sql(f"select {', '.join(breakdowns)}, {means} from {{met}} group by grouping sets ({sets})", met=met)


def sweep(runs: DataFrame, config: str, metric: str) -> DataFrame:
    """runs (config, metric) -> mean by config and its distance from the best."""
    means = runs.groupBy(config).agg(F.round(F.avg(metric), 6).alias("mean"), F.count("*").alias("n"))
    return means.withColumn("behind", F.round(F.max("mean").over(Window.partitionBy(F.lit(0))) - F.col("mean"), 6))


def forms(lines: DataFrame, key: str) -> DataFrame:
    """lines (key, no, line) of filled-in forms -> (key, section, choice, problem).

    '## name' opens a section, '- [x] choice' is checked. A section has one check: none or several are
    problems. The open section goes forward over the lines of a form by a window.
    """
    heading = F.nullif(F.regexp_extract("line", r"^## +(.*?) *$", 1), F.lit(""))
    box = F.regexp_extract("line", r"^ *- \[([ xX])\] +(.*?) *$", 1)
    w = Window.partitionBy(key).orderBy("no")
    each = lines.select(key, "no", F.last(heading, ignorenulls=True).over(w).alias("section"), box.alias("box"), F.regexp_extract("line", r"^ *- \[([ xX])\] +(.*?) *$", 2).alias("choice"))
    checked = F.lower("box") == "x"
    found = each.where("section is not null and box <> ''").groupBy(key, "section").agg(F.count_if(checked).alias("n"), F.max(F.when(checked, F.col("choice"))).alias("choice"))
    return found.select(key, "section", F.when(F.col("n") == 1, F.col("choice")).alias("choice"), F.when(F.col("n") == 0, "unchecked").when(F.col("n") > 1, "several").alias("problem"))


def unsupported(answer: Column, sentence: str) -> Column:
    """The answer with a sentence that nothing supports."""
    return F.concat(F.rtrim(answer), F.lit(" "), F.lit(sentence))


def swapped_name(answer: Column, names: Column) -> Column:
    """The first of the names that is in the answer replaced by the first that is not; null where either lacks."""
    inside = F.filter(names, lambda n: F.contains(answer, n))
    outside = F.filter(names, lambda n: ~F.contains(answer, n))
    return F.when((F.size(inside) > 0) & (F.size(outside) > 0), F.replace(answer, F.try_element_at(inside, F.lit(1)), F.try_element_at(outside, F.lit(1))))


def off_topic(answers: DataFrame, key: str) -> DataFrame:
    """Each answer goes to the question before it in order of keys, the first to the last: a rotation.

    Keys, which are unique, are sorted in ranges; a range's last answer comes from the first of the next one.
    """
    ordered = answers.repartitionByRange(key).sortWithinPartitions(key).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    ordered = scratch(ordered, "rotated")
    # one row a range
    order = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = ordered.groupBy("_part").agg(F.min_by(F.struct("answer"), "_row").alias("_first"))
    firsts = firsts.select("_part", F.coalesce(F.lead("_first").over(Window.orderBy("_part")), F.first("_first").over(order)).alias("_after"))
    moved = ordered.withColumn("_next", F.lead(F.struct("answer")).over(Window.partitionBy("_part").orderBy("_row"))).join(firsts, "_part")
    return moved.withColumn("answer", F.coalesce("_next", "_after")["answer"]).select(*answers.columns)


def compared(cases: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """cases (key, kind, score) against base (key, score): worse, same and better by kind."""
    met = cases.join(base.select(key, F.col("score").alias("_base")), key)
    return met.groupBy("kind").agg(F.count_if(F.col("score") < F.col("_base")).alias("worse"), F.count_if(F.col("score") == F.col("_base")).alias("same"), F.count_if(F.col("score") > F.col("_base")).alias("better"))


def to_ids(numbers: Column, ids: Column) -> Column:
    """Counted from 1 to ids; null for a number out of range."""
    return F.transform(numbers, lambda n: F.when((n >= 1) & (n <= F.size(ids)), F.try_element_at(ids, n)))


def last_rows(numbers: Column, most: int, n: int) -> Column:
    """Distinct whole numbers within 1..most, the first n."""
    return F.slice(F.array_distinct(F.filter(numbers, lambda x: x.isNotNull() & (x >= 1) & (x <= most))), 1, n)


def valid_echo(reply: Column, asked: Column, labels: list[str]) -> Column:
    """reply array<struct<item, label>>: the asked items in their order, each with one of the labels."""
    return F.coalesce((F.transform(reply, lambda r: r["item"]) == asked) & F.forall(reply, lambda r: r["label"].isin(*labels)), F.lit(False))


def blind_sample(rows: list[tuple[str, str, int]], m: int, clean_share: float, seed: int) -> list[str]:
    """rows (id, cluster, failures): one of each cluster in a permuted order, a share of clean ones, then the most failing.

    Backfilled from either side; in the permuted order. Fails where there are fewer clusters than m.
    """
    by_id = sorted(rows)
    order = [by_id[i] for i in np.random.default_rng(seed).permutation(len(by_id))]
    firsts: dict[str, tuple] = {}
    for r in order:
        firsts.setdefault(r[1], r)
    pool = list(firsts.values())
    if len(pool) < m:
        raise ValueError(f"{len(pool)} clusters, {m} wanted")
    clean = [r for r in pool if r[2] == 0]
    failing = sorted((r for r in pool if r[2] > 0), key=lambda r: -r[2])
    want = min(round(m * clean_share), len(clean))
    picked = clean[:want] + failing[: m - want]
    picked += clean[want : want + m - len(picked)]
    ids = {r[0] for r in picked}
    return [r[0] for r in pool if r[0] in ids]


def run_in_order(items: list, work: Callable, workers: int = 4, passes: int = 2, most_failures: int = 5) -> list:
    """Results of work on items, in their order: concurrent, only failures again, stopping after failures in a row.

    Remaining failures raise one error that lists them. For calls to outside services from the driver.
    """
    results: dict[int, object] = {}
    errors: dict[int, Exception] = {}
    left = list(range(len(items)))
    for _ in range(1 + passes):
        errors, in_row = {}, 0
        with ThreadPoolExecutor(workers) as pool:
            futures = [(i, pool.submit(work, items[i])) for i in left]
            for i, f in futures:
                if in_row >= most_failures:
                    f.cancel()
                    errors[i] = errors.get(i) or RuntimeError("not tried")
                    continue
                try:
                    results[i] = f.result()
                    in_row = 0
                except Exception as e:  # noqa: BLE001 kept, tried again, reported
                    errors[i] = e
                    in_row += 1
        left = sorted(errors)
        if not left:
            return [results[i] for i in range(len(items))]
    raise RuntimeError("; ".join(f"{items[i]!r}: {errors[i]}" for i in left))


def seeded_subset(keys: list, seed: int, n: int) -> list:
    """n of the sorted keys without replacement, sorted."""
    return sorted(random.Random(seed).sample(sorted(keys), n))


class Holdout:
    """Keeps a test layer from being read before it is allowed, and from being scored twice."""

    def __init__(self, ids: set, allowed: bool = False):
        self.ids, self.allowed, self.used = frozenset(ids), allowed, False

    def check(self, ids: set) -> None:
        if self.ids & set(ids):
            if not self.allowed:
                raise PermissionError("ids of the test layer")
            if self.used:
                raise PermissionError("the test layer was scored before")
            self.used = True


def fill_profile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_profile(table(spark, sf_dir, "documents").drop("text"), ["doc_id", "lang", "source", "n_chars"])


def metric_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of labels less those of the label 200 ids before, by language and overall."""
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    shifted = labels.select((F.col("doc_id") - 40).alias("doc_id"), "quality", "toxic")
    return diff_table(labels, shifted, ["doc_id"], ["quality", "toxic"], ["lang"])


def config_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as configurations, quality as the metric."""
    runs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return sweep(runs, "source", "quality")


def checkbox_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form for each label: quality checks one of two boxes, toxicity one or both."""
    line = F.array(
        F.lit("# form"), F.lit("## quality"), F.concat(F.lit("- ["), F.when(F.col("quality") == 1, "x").otherwise(" "), F.lit("] good")), F.concat(F.lit("- ["), F.when(F.col("quality") == 0, "X").otherwise(" "), F.lit("] bad")),
        F.lit("## toxic"), F.concat(F.lit("- ["), F.when(F.col("toxic") == 1, "x").otherwise(" "), F.lit("] yes")), F.concat(F.lit("- ["), F.when((F.col("toxic") == 1) & (F.col("doc_id") % 2 == 0), "x").otherwise(" "), F.lit("] no")),
    )
    lines = table(spark, sf_dir, "labels").select("doc_id", F.posexplode(line).alias("no", "line"))
    return forms(lines, "doc_id")


def perturbed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with an unsupported sentence and with a swapped word, as lengths and digests."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant' and text is not null")
    names = F.array(*map(F.lit, ("the", "der", "les", "que")))
    swapped = swapped_name(F.col("text"), names)
    return turns.select("conv_id", "turn", F.length(unsupported(F.col("text"), "It was never so.")).cast("bigint").alias("longer"), F.sha1(swapped.cast("binary")).alias("swapped"))


def off_topic_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with the text of the next one, in order of conversations and turns."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.struct("conv_id", "turn").alias("key"), F.col("text").alias("answer"))
    return off_topic(turns, "key").select("conv_id", "turn", F.sha1(F.col("answer").cast("binary")).alias("digest"))


QUERIES = {"fill_profile": fill_profile_query, "metric_diffs": metric_diffs, "config_sweep": config_sweep, "checkbox_forms": checkbox_forms, "perturbed_answers": perturbed_answers, "off_topic_answers": off_topic_answers}
ORACLES = {
    "off_topic_answers": """select conv_id, turn, sha1(case when row_number() over w = count(*) over () then first_value(text) over w else lead(text) over w end) as digest
from conversations where role = 'assistant' window w as (order by conv_id, turn)""",
    "fill_profile": " union all ".join(f"select '{c}' as field, count(*) filter (trim({c}::varchar) <> '') as filled, count(*) filter (trim({c}::varchar) = '') as \"empty\", count(*) filter ({c} is null) as missing from documents" for c in ("doc_id", "lang", "source", "n_chars")),
    "metric_diffs": """with l as (select l.*, d.lang from labels l join documents d using (doc_id)), m as (select a.lang, b.quality - a.quality as q, b.toxic - a.toxic as t from l a join l b on a.doc_id = b.doc_id - 40)
select lang, round(avg(q), 6) as quality, count(q) as n_quality, round(avg(t), 6) as toxic, count(t) as n_toxic from m group by grouping sets ((), (lang))""",
    "config_sweep": """with m as (select source, round(avg(quality), 6) as mean, count(*) as n from labels join documents using (doc_id) group by source)
select source, mean, n, round(max(mean) over () - mean, 6) as behind from m""",
    "checkbox_forms": """select doc_id, 'quality' as section, case when quality = 1 then 'good' when quality = 0 then 'bad' end as choice, case when quality not in (0, 1) or quality is null then 'unchecked' end as problem from labels
union all select doc_id, 'toxic', case when toxic = 1 and doc_id % 2 <> 0 then 'yes' end, case when toxic = 1 and doc_id % 2 = 0 then 'several' when toxic is null or toxic <> 1 then 'unchecked' end from labels""",
    "perturbed_answers": """with n as (select conv_id, turn, text, list_filter(['the', 'der', 'les', 'que'], lambda x: contains(text, x)) as i, list_filter(['the', 'der', 'les', 'que'], lambda x: not contains(text, x)) as o
from conversations where role = 'assistant' and text is not null)
select conv_id, turn, length(rtrim(text)) + 17 as longer, case when len(i) > 0 and len(o) > 0 then sha1(replace(text, i[1], o[1])) end as swapped from n""",
}
