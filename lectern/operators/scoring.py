"""Recognition scoring: join references with hypotheses, measure edits, aggregate.

``score_pairs`` and ``score_systems`` compute each edit distance once; every report is a
map-side-combined aggregate over their output, so no report shuffles texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.distance import edit_distance, edit_distances

CLEAN = "clean"


def last_per_uid(rows: DataFrame, uid: str, position: Column) -> DataFrame:
    """A uid that occurs twice keeps its last row."""
    rest = [c for c in rows.columns if c != uid]
    return rows.groupBy(uid).agg(
        F.max_by(F.struct(*rest), position).alias("_row")
    ).select(uid, *[F.col(f"_row.{c}").alias(c) for c in rest])


def score_pairs(refs: DataFrame, hyps: DataFrame) -> DataFrame:
    """Join ``refs(uid, ref, ...)`` with ``hyps(uid, hyp, ...)`` and measure every pair once.

    Both texts are normalised before the join, so only the scoring forms are shuffled. Group
    columns of the hypotheses (system, condition) stay on the rows. References without a
    hypothesis add no rows; ``cer`` accounts for them from ``reference_totals``.
    """
    r = refs.withColumn("r", T.norm("ref")).drop("ref")
    h = hyps.withColumn("h", T.norm(F.coalesce("hyp", F.lit("")))).drop("hyp")
    return _measured(r.join(h, "uid"))


def score_variants(refs: DataFrame, hyps: DataFrame) -> DataFrame:
    """``score_pairs`` for ``hyps(uid, hyps)``, all texts of a uid in one array of structs with a field ``hyp``.

    A uid is joined once and its reference measured against all of them; the other fields (system, condition) become columns.
    """
    r = refs.withColumn("r", T.norm("ref")).drop("ref")
    h = hyps.withColumn("hyps", F.transform("hyps", lambda x: x.withField("hyp", T.norm(F.coalesce(x["hyp"], F.lit(""))))))
    rows = r.join(h, "uid").withColumn("_e", edit_distances("r", F.transform("hyps", lambda x: x["hyp"])))
    each = rows.select(*r.columns, F.inline(F.arrays_zip(F.col("hyps").alias("_h"), F.col("_e").alias("errors"))))
    rest = [f.name for f in h.schema["hyps"].dataType.elementType.fields if f.name != "hyp"]
    return each.select(
        *[c for c in r.columns if c != "r"], *[F.col("_h")[c].alias(c) for c in rest], "errors",
        F.length("r").cast("bigint").alias("ref_len"), (F.col("r") == F.col("_h.hyp")).alias("exact"),
    )


def _measured(pairs: DataFrame) -> DataFrame:
    return (
        pairs.withColumn("errors", edit_distance("r", "h"))
        .withColumn("ref_len", F.length("r").cast("bigint"))
        .withColumn("exact", F.col("r") == F.col("h"))
        .drop("r", "h")
    )


def reference_totals(refs: DataFrame) -> DataFrame:
    """One row: number of references and their normalised length under both weightings."""
    n = F.length(T.norm("ref")).cast("bigint")
    return refs.agg(
        F.count("*").alias("n_ref"),
        F.coalesce(F.sum(n), F.lit(0)).alias("len_ref"),
        F.coalesce(F.sum(F.greatest(F.lit(1), n)), F.lit(0)).alias("len_ref_floor"),
        F.count_if(n == 0).alias("empty_ref"),
    )


def paired_systems(refs: DataFrame, a: DataFrame, b: DataFrame, mode: str = "inner") -> DataFrame:
    """References with two systems side by side.

    ``inner`` keeps uids both systems have; ``zero`` scores a missing text as fully deleted.
    """
    how = {"inner": "inner", "zero": "left"}[mode]

    def side(hyps: DataFrame, s: str) -> DataFrame:
        text = F.coalesce("hyp", F.lit(""))
        return hyps.select("uid", T.norm(text).alias(f"h_{s}"), F.col("hyp").alias(f"hyp_{s}"))

    out = (
        refs.withColumn("r", T.norm("ref"))
        .join(side(a, "a"), "uid", how)
        .join(side(b, "b"), "uid", how)
    )
    return _compared(out)


def paired_columns(refs: DataFrame, both: DataFrame) -> DataFrame:
    """``paired_systems`` where one table, ``both(uid, hyp_a, hyp_b)``, holds the texts of the two: one join."""
    heard = [T.norm(F.coalesce(f"hyp_{s}", F.lit(""))).alias(f"h_{s}") for s in "ab"]
    return _compared(refs.withColumn("r", T.norm("ref")).join(both.select("*", *heard), "uid"))


def _compared(out: DataFrame) -> DataFrame:
    for s in "ab":
        out = out.withColumn(f"h_{s}", F.coalesce(f"h_{s}", F.lit("")))
        out = out.withColumn(f"errors_{s}", edit_distance("r", f"h_{s}"))
    return out.withColumn("ref_len", F.length("r").cast("bigint"))


def _rate(errors: Column, length: Column) -> Column:
    return errors / F.greatest(F.lit(1), length)


def cer(
    scored: DataFrame, totals: DataFrame, by: list[str], weighting: str | list[str] = "inner"
) -> DataFrame:
    """Character error rate, sentence accuracy and counts per group.

    A list of weightings gives one row per group and weighting, from one pass over the pairs.

    weighting:
      ``inner``     only uids with a hypothesis; denominator max(1, total length); an empty
                    reference weighs nothing
      ``zero``      a missing hypothesis counts as an empty text
      ``per_row``   like ``zero``; every row weighs at least one character
      ``drop_empty`` like ``inner``, uids with an empty normalised reference are left out
    """
    empty = F.col("ref_len") == 0
    sums = scored.groupBy(*by).agg(
        F.count("*").alias("found"),
        F.count_if(empty).alias("_empty"),
        F.sum("errors").alias("_err"),
        F.coalesce(F.sum(F.when(empty, F.col("errors"))), F.lit(0)).alias("_err_empty"),
        F.sum("ref_len").alias("_len"),
        F.count_if("exact").alias("_exact"),
        F.count_if(F.col("exact") & empty).alias("_exact_empty"),
    )
    # One scalar subquery for all totals, evaluated once.
    packed = totals.select(F.struct(*totals.columns)).scalar()
    sums = sums.withColumn("_t", packed)
    total = {c: F.col("_t")[c] for c in totals.columns}
    # What the references without a hypothesis would add: all their characters as deletions.
    lost = total["len_ref"] - F.col("_len")
    missing = total["n_ref"] - F.col("found")
    forms = {
        "inner": (F.col("found"), F.col("_err") - F.col("_err_empty"), F.col("_len"), F.col("_exact")),
        "drop_empty": (
            F.col("found") - F.col("_empty"),
            F.col("_err") - F.col("_err_empty"),
            F.col("_len"),
            F.col("_exact") - F.col("_exact_empty"),
        ),
        "zero": (
            total["n_ref"],
            F.col("_err") + lost,
            total["len_ref"],
            F.col("_exact") + total["empty_ref"] - F.col("_empty"),
        ),
        "per_row": (
            total["n_ref"],
            F.col("_err") + lost,
            total["len_ref_floor"],
            F.col("_exact") + total["empty_ref"] - F.col("_empty"),
        ),
    }

    def form(name: str) -> Column:
        n, errors, length, exact = forms[name]
        return F.struct(
            F.lit(name).alias("weighting"), n.alias("n"), errors.alias("errors"),
            length.alias("ref_len"), exact.alias("n_exact"),
        )

    several = isinstance(weighting, list)
    names = weighting if several else [weighting]
    rows = sums.select(
        *by, total["n_ref"].alias("n_ref"), missing.alias("missing"),
        F.inline(F.array(*[form(w) for w in names])),
    )
    if not several:
        rows = rows.drop("weighting")
    return rows.withColumn("cer", _rate(F.col("errors"), F.col("ref_len"))).withColumn(
        "sent_acc", F.col("n_exact") / F.greatest(F.lit(1), F.col("n"))
    )


def win_loss_tie(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How often system b needs fewer, more or as many edits as system a."""
    a, b = F.col("errors_a"), F.col("errors_b")
    return pairs.groupBy(*(by or [])).agg(
        F.count_if(b < a).alias("improved"),
        F.count_if(b > a).alias("worsened"),
        F.count_if(a == b).alias("same"),
    )


def relative_change(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Absolute and relative change of the error rate from a to b, guarded against zero."""
    sums = pairs.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("errors_a"), F.lit(0)).alias("errors_a"),
        F.coalesce(F.sum("errors_b"), F.lit(0)).alias("errors_b"),
        F.coalesce(F.sum("ref_len"), F.lit(0)).alias("ref_len"),
    )
    out = sums.withColumn("cer_a", _rate(F.col("errors_a"), F.col("ref_len"))).withColumn(
        "cer_b", _rate(F.col("errors_b"), F.col("ref_len"))
    )
    return out.withColumn("delta", F.col("cer_b") - F.col("cer_a")).withColumn(
        "relative_pct",
        F.when(F.col("cer_a") == 0, F.lit(0.0)).otherwise(
            F.col("delta") / F.when(F.col("cer_a") != 0, F.col("cer_a")) * 100
        ),
    )


def subset_cer(pairs: DataFrame, flag: Column) -> DataFrame:
    """Error rates of all rows, flagged rows and the rest, in one pass."""
    three = pairs.withColumn("_flag", flag).withColumn(
        "subset",
        F.explode(F.array(F.lit("all"), F.when(F.col("_flag"), "numeral").otherwise("other"))),
    )
    return relative_change(three, ["subset"])


def error_attribution(pairs: DataFrame, flag: Column) -> DataFrame:
    """Which share of the net error reduction the flagged subset contributes."""
    sums = (
        pairs.withColumn("_f", flag)
        .agg(
            *[
                F.coalesce(F.sum(F.when(cond, F.col(f"errors_{s}"))), F.lit(0)).alias(f"{name}_{s}")
                for name, cond in (("numeral", F.col("_f")), ("other", ~F.col("_f")))
                for s in "ab"
            ],
            F.count_if("_f").alias("n_numeral"),
            F.count_if(F.col("_f") & (F.col("errors_b") < F.col("errors_a"))).alias("improved_numeral"),
            F.count_if(F.col("errors_b") < F.col("errors_a")).alias("improved"),
        )
        .withColumn(
            "net",
            F.col("numeral_a") + F.col("other_a") - F.col("numeral_b") - F.col("other_b"),
        )
    )
    floor_net = F.greatest(F.lit(1), F.col("net"))
    return (
        sums.withColumn("numeral_share", (F.col("numeral_a") - F.col("numeral_b")) / floor_net)
        .withColumn("other_share", (F.col("other_a") - F.col("other_b")) / floor_net)
        .withColumn(
            "improved_share", F.col("improved_numeral") / F.greatest(F.lit(1), F.col("improved"))
        )
    )


def bucket_cer(pairs: DataFrame, bucket: Column) -> DataFrame:
    """Error rates per length bucket or recording; empty references are skipped."""
    out = relative_change(pairs.filter("ref_len > 0").withColumn("bucket", bucket), ["bucket"])
    return out.withColumn("delta_points", F.col("delta") * 100)


def robustness_matrix(scored: DataFrame, totals: DataFrame) -> DataFrame:
    """Error rate per system and condition, and its ratio to the clean condition."""
    rates = cer(scored, totals, ["system", "condition"], "per_row")
    # A handful of rows per system: the clean rate comes from a window, not from a second pass.
    clean = F.max(F.when(F.col("condition") == CLEAN, F.col("cer"))).over(Window.partitionBy("system"))
    return rates.withColumn("_clean", clean).withColumn(
        "degradation", F.when(F.col("_clean") > 0, F.try_divide("cer", "_clean"))
    ).drop("_clean")


def punct_rate(texts: DataFrame, by: list[str], text: str = "text", pattern: str = T.CJK_PUNCTUATION) -> DataFrame:
    """Share of texts that contain a punctuation mark."""
    flag = F.coalesce(T.has_punct(text, pattern), F.lit(False))
    return (
        texts.groupBy(*by)
        .agg(F.count("*").alias("n"), F.count_if(flag).alias("with_punct"))
        .withColumn("rate", F.col("with_punct") / F.greatest(F.lit(1), F.col("n")))
    )


def worst_regressions(pairs: DataFrame, k: int, order: list[str], by: list[str] | None = None) -> DataFrame:
    """The k rows with the largest rise in errors; rows that did not get worse never appear."""
    worse = pairs.withColumn("regression", F.col("errors_b") - F.col("errors_a")).filter("regression > 0")
    return _first_k(worse, by or [], [F.desc("regression"), *order], k)


def first_examples(pairs: DataFrame, k: int, order: list[str]) -> DataFrame:
    """The first k improved and the first k worsened rows in reference order."""
    change = (
        F.when(F.col("errors_b") < F.col("errors_a"), "improved")
        .when(F.col("errors_b") > F.col("errors_a"), "worsened")
        .otherwise("same")
    )
    return _first_k(
        pairs.withColumn("change", change).filter("change <> 'same'"), ["change"], order, k
    )


def _first_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """Top k per group: each task keeps k rows before anything is shuffled."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def evaluated_only(refs: DataFrame, hyps: DataFrame) -> DataFrame:
    """References that have a hypothesis."""
    return refs.join(hyps.select("uid"), "uid", "left_semi")


def excluding(refs: DataFrame, uids: DataFrame) -> DataFrame:
    """References whose uid is not listed."""
    return refs.join(uids.select("uid"), "uid", "left_anti")


def report_map(rates: DataFrame, tag: Column) -> DataFrame:
    """One report row per tag: its conditions as a map (a handful of entries)."""
    entry = F.struct(
        "condition", F.struct("cer", "sent_acc", F.col("n").alias("n"), "sec").alias("score")
    )
    return rates.groupBy(tag.alias("tag")).agg(
        F.max("n").alias("n_sample"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("conditions"),
    )
