"""Quality rules whose cutoffs adapt to each language and source.

Texts are measured in one pass. The measures of one group are sketched as counts by value class: 32
classes to a doubling, so that a quantile read from a sketch is at most a 32nd too low, at any number of
rows. Sketches of parts or groups are merged by adding counts, in any order and with one result. The
cutoffs come from quantiles of the sketches and are joined back to the rows they judge.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, blank_words, let, staged

SYMBOLS = "#*$%&|<>"
#: Classes to a doubling, as a power of two.
PRECISION_BITS = 5
#: Copies of each cutoff row, over which the rows of one group are dealt in the join.
SALTS = 16


@dataclass(frozen=True)
class Rule:
    """A measure in whole units and how far from its group's median a text may lie.

    The spread of a group is its median less its tenth percentile: half of a group may be bad and the
    spread is still that of good texts. It counts as ``least_spread`` at least, so that a group of
    equal values does not reject the first other value.
    """

    name: str
    value: Column
    least_spread: int
    spreads: int = 6
    below: bool = False


def default_rules() -> list[Rule]:
    words, chars = F.col("n_words"), F.col("word_chars")
    return [
        Rule("symbols", _share("n_symbols", "word_chars"), 40),
        Rule("repeated_lines", _share("n_dup_lines", "n_lines"), 600),
        Rule("repeated_words", _share("n_repeat_words", "n_words"), 500),
        Rule("word_length", F.when(words > 0, F.expr("(100 * word_chars) div n_words")).otherwise(0 * chars), 30, below=True),
    ]


def _share(part: str, whole: str) -> Column:
    """Parts in 10,000, in whole numbers."""
    return F.when(F.col(whole) > 0, F.expr(f"(10000 * {part}) div {whole}")).otherwise(F.lit(0)).cast("long")


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the same text."""

    def in_windows(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - 2)
        three = lambda i: (F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))
        # As many hashes as windows: no two windows are alike. Otherwise the words themselves are compared.
        hashes = F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*three(i))))
        spelled = F.transform(starts, lambda i: F.concat_ws(" ", *three(i)))
        return F.when(F.size(hashes) == F.size(w) - 2, 0).otherwise(let(spelled, covered))

    def covered(windows: Column) -> Column:
        places = F.sort_array(F.transform(windows, lambda s, i: F.struct(s.alias("s"), i.alias("i"))))
        return let(
            places,
            lambda p: F.size(
                F.array_distinct(
                    F.flatten(
                        F.transform(
                            F.filter(p, lambda x, i: _same(p, x, i - 1) | _same(p, x, i + 1)),
                            lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2),
                        )
                    )
                )
            ),
        )

    def _same(places: Column, x: Column, i: Column) -> Column:
        return F.coalesce(F.get(places, i)["s"] == x["s"], F.lit(False))

    return let(words, lambda w: F.when(F.size(w) < 3, 0).otherwise(in_windows(w))).cast("long")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measured(docs: DataFrame, carry: tuple[Column, ...] = ()) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, what is carried along, and the counts of every text, from one
    pass over whole texts."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    found = docs.select(
        "doc_id",
        "lang",
        "source",
        *carry,
        let(
            blank_words(text),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                repeated_words(w).alias("n_repeat_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            ),
        ).alias("w"),
        (F.length(text) - F.length(reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SYMBOLS, text)))
        .cast("long")
        .alias("n_symbols"),
        let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            ),
        ).alias("l"),
    )
    return found.select("*", "w.*", "l.*").select(*docs.select("doc_id", "lang", "source", *carry).columns, *COUNTS)


def base_failed() -> Column:
    """Too short, or made of repetition for the greater part."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketch(rows: DataFrame, by: list[str], rules: list[Rule]) -> DataFrame:
    """``by``, ``rule``, ``class`` (the least value of the class) and ``n``: mergeable counts."""
    values = F.array(*(F.struct(F.lit(r.name).alias("rule"), r.value.alias("value")) for r in rules))
    long = rows.select(*by, F.inline(values))
    low = "greatest(length(bin(value)) - %d, 0)" % (PRECISION_BITS + 1)
    lowest = F.expr(f"shiftleft(shiftright(value, {low}), {low})")
    return long.groupBy(*by, "rule", lowest.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """One sketch for all that share ``by``: counts add up."""
    return sketches.groupBy(*by, "rule", "class").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], percents: dict[str, int]) -> DataFrame:
    """``by``, ``rule``, ``rows`` and one column a quantile: the class in which that share is reached.

    The window holds the classes of one sketch, some hundreds at most, however many rows it counts.
    """
    keys = [*by, "rule"]
    upto = Window.partitionBy(*keys).orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    sums = sketches.withColumn("upto", F.sum("n").over(upto)).withColumn(
        "rows", F.sum("n").over(Window.partitionBy(*keys))
    )
    return sums.groupBy(*keys).agg(
        F.max("rows").alias("rows"),
        *(
            F.min(F.when(F.col("upto") * 100 >= F.col("rows") * percent, F.col("class"))).alias(name)
            for name, percent in percents.items()
        ),
    )


def cutoffs(leaves: DataFrame, rules: list[Rule], least_rows: int) -> DataFrame:
    """``lang``, ``source`` and an array ``limits`` of (rule, low, high) for every pair of the sketches.

    A pair with fewer than ``least_rows`` rows is judged by its language's merged sketch, a language
    with fewer by that of all.
    """
    levels, asked = [["lang", "source"], ["lang"], []], {"middle": 50, "tenth": 10}
    found = [
        quantiles(leaves if i == 0 else merged(leaves, by), by, asked)
        .select(
            *(F.col(c).alias(f"{c}_{i}") for c in by),
            F.col("rule").alias(f"rule_{i}"),
            F.struct("rows", "middle", "tenth").alias(f"q_{i}"),
        )
        for i, by in enumerate(levels)
    ]
    pairs = found[0].withColumnsRenamed({"lang_0": "lang", "source_0": "source", "rule_0": "rule"})
    both = pairs.join(
        found[1], F.col("lang").eqNullSafe(F.col("lang_1")) & (F.col("rule") == F.col("rule_1"))
    ).join(found[2], F.col("rule") == F.col("rule_2"))
    q = (
        F.when(F.col("q_0.rows") >= least_rows, F.col("q_0"))
        .when(F.col("q_1.rows") >= least_rows, F.col("q_1"))
        .otherwise(F.col("q_2"))
    )
    terms = F.create_map(
        *(
            x
            for r in rules
            for x in (
                F.lit(r.name),
                F.struct(
                    F.lit(r.least_spread).cast("long").alias("least"),
                    F.lit(r.spreads).cast("long").alias("spreads"),
                    F.lit(r.below).alias("below"),
                ),
            )
        )
    )
    said = both.select("lang", "source", "rule", q.alias("q"), F.element_at(terms, F.col("rule")).alias("t"))
    room = F.col("t.spreads") * F.greatest(F.col("q.middle") - F.col("q.tenth"), F.col("t.least"))
    return said.groupBy("lang", "source").agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(
                    "rule",
                    F.struct(
                        F.when(F.col("t.below"), F.col("q.middle") - room).alias("low"),
                        (F.col("q.middle") + room).alias("high"),
                    ),
                )
            )
        ).alias("limits")
    )


def learned(rows: DataFrame, rules: list[Rule], least_rows: int) -> DataFrame:
    """The cutoffs of measured rows, from those that pass the base rules."""
    leaves = staged(sketch(rows.where(~base_failed()), ["lang", "source"], rules), "sketch")
    return staged(cutoffs(leaves, rules, least_rows), "cutoffs")


def judged(rows: DataFrame, limits: DataFrame, rules: list[Rule]) -> DataFrame:
    """Measured rows with ``base_failed``, ``failed_rules`` and ``kept``, by a join with their cutoffs."""
    renamed = limits.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    dealt = renamed.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("doc_id", "word_chars", "n_words"), F.lit(SALTS)).cast("int")
    both = rows.withColumn("salt", salt).join(
        dealt,
        F.col("lang").eqNullSafe(F.col("of_lang"))
        & F.col("source").eqNullSafe(F.col("of_source"))
        & (F.col("salt") == F.col("of_salt")),
        "left",
    )

    def outside(rule: Rule) -> Column:
        limit = F.col("limits")[rule.name]
        return F.when((rule.value > limit["high"]) | (rule.value < limit["low"]), F.lit(rule.name))

    failed = F.filter(F.array(*map(outside, rules)), lambda name: name.isNotNull())
    found = both.withColumn("base_failed", base_failed()).withColumn(
        "failed_rules", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(failed)
    )
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return found.select(*rows.columns, "base_failed", "failed_rules", kept.alias("kept"))


def judge(docs: DataFrame, rules: list[Rule] | None = None, least_rows: int = 100) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``lang``, ``source``, the counts, ``base_failed``,
    ``failed_rules`` (names, in the order of the rules) and ``kept``.

    Cutoffs are taken over all rows that pass the base rules and hold for the rows' own language and
    source, null being a language or source of its own. A value is refused above the median by more
    than ``spreads`` spreads of its group (see ``Rule``), for rules with ``below`` also that far below.

    A null text has no words and fails the base. Repeated rows count as often as they occur and are
    judged alike. Columns other than ``doc_id``, ``text``, ``lang`` and ``source`` are ignored, whatever
    their names. An empty table gives no rows. The counts are written once and read twice; a group that
    holds most rows is added up before it moves, and dealt over several tasks in the join.
    """
    rules = default_rules() if rules is None else rules
    rows = staged(measured(docs), "measures")
    return judged(rows, learned(rows, rules, least_rows), rules)


def select_documents(docs: DataFrame, rules: list[Rule] | None = None, least_rows: int = 100) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns and as often as they occur."""
    rules = default_rules() if rules is None else rules
    limits = learned(measured(docs), rules, least_rows)
    rows = measured(docs, (F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"),))
    return judged(rows, limits, rules).where("kept").select("doc.*")
