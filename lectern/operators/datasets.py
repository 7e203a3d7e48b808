"""Building training sets: pairing, sampling, splitting, counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.ordered import global_rank, range_rank

# Sample sizes and the wording of a chat sample.
SAMPLE_N = 80
VAL_EVERY = 8
SHUFFLE_SEED = 42
SYSTEM_TEXT = "You are a helpful assistant."
TASK_TEXT = "语音转写："
SPEECH_OPEN, SPEECH_CLOSE = "<|startofspeech|>!", "<|endofspeech|>"
ERRORS_SHOWN = 10


def pair_status(left_id: Column, right_id: Column) -> Column:
    return (
        F.when(left_id.isNull(), "right_only")
        .when(right_id.isNull(), "left_only")
        .when(left_id != right_id, "mismatch")
        .otherwise("matched")
    )


def pair_by_position(manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """Pair line n of a manifest(line_no, uid, path) with line n of texts(line_no, uid, text).

    Every line gets a status: ``matched``, ``mismatch`` (uids differ, with a message),
    ``malformed`` (a blank or one-field line) or ``left_only`` / ``right_only`` past the shorter
    list. Both sides are hash-partitioned by line number, so no file is read by one task.
    """
    a = manifest.select("line_no", F.col("uid").alias("uid_a"), "path", F.lit(True).alias("_a"))
    b = texts.select("line_no", F.col("uid").alias("uid_b"), "text", F.lit(True).alias("_b"))
    rows = a.join(b, "line_no", "full_outer")
    broken = (
        F.col("uid_a").isNull() | F.col("path").isNull() | F.col("uid_b").isNull() | F.col("text").isNull()
    )
    status = (
        F.when(F.col("_a").isNull(), "right_only")
        .when(F.col("_b").isNull(), "left_only")
        .when(broken, "malformed")
        .when(F.col("uid_a") != F.col("uid_b"), "mismatch")
        .otherwise("matched")
    )
    error = F.when(
        status == "mismatch", F.concat(F.lit("UTT mismatch: "), "uid_a", F.lit(" vs "), "uid_b")
    )
    return rows.select("line_no", "uid_a", "uid_b", "path", "text", status.alias("status"), error.alias("error"))


def pair_by_uid(manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """Keyed variant: full outer join on uid with a status."""
    a = manifest.select("uid", "path", F.lit(True).alias("_a"))
    b = texts.select("uid", "text", F.lit(True).alias("_b"))
    rows = a.join(b, "uid", "full_outer")
    status = (
        F.when(F.col("_a").isNull(), "right_only").when(F.col("_b").isNull(), "left_only").otherwise("matched")
    )
    return rows.select("uid", "path", "text", status.alias("status"))


def hash_bucket(uid: str, seed: int = SHUFFLE_SEED) -> tuple[Column, Column]:
    """(shuffle key, bucket): a seeded digest and its first four hex digits, evenly spread over 65,536 values."""
    digest = F.md5(F.concat_ws("#", F.lit(str(seed)), F.col(uid).cast("string")))
    return digest, F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")


def train_val_split(utterances: DataFrame, uid: str = "utt_id", every: int = VAL_EVERY,
                    seed: int = SHUFFLE_SEED) -> DataFrame:
    """Shuffle by a seeded digest of the id; every eighth row goes to validation.

    The rank in shuffle order is exact but never sorts the table in one task: rows are ranked
    inside 65,536 digest buckets (1.5 million rows each of 10^11), and the bucket sizes supply the offsets.
    """
    digest, bucket = hash_bucket(uid, seed)
    ranked = global_rank(utterances.withColumn("_digest", digest), ["_digest", uid], bucket, "_rank")
    split = F.when((F.col("_rank") - 1) % every == 0, "val").otherwise("train")
    return ranked.withColumn("split", split).drop("_digest", "_rank")


def systematic_sample(rows: DataFrame, uid: str = "uid", n: int = SAMPLE_N) -> DataFrame:
    """Sort by uid, take every (N div n)-th row, at most n: a spread-out sample.

    Only uids and row hashes are ranked, in ranges that grow in number with the rows; the few chosen ones, ``n`` at most,
    then pick the rows. Rows of one uid follow each other by their hash, of equal rows as many are taken as were chosen.
    """
    total = rows.count()
    step = max(1, total // n)
    keyed = rows.withColumn("_hash", F.xxhash64(*[c for c, t in rows.dtypes if "map<" not in t]))
    ranked = range_rank(keyed.select(uid, "_hash"), [uid, "_hash"], total, "_rank")
    chosen = ranked.filter(((F.col("_rank") - 1) % step == 0) & (F.col("_rank") <= step * n))
    wanted = chosen.groupBy(F.col(uid).alias("_uid"), F.col("_hash").alias("_of")).agg(F.count("*").alias("_times"))
    found = keyed.join(F.broadcast(wanted), F.col(uid).eqNullSafe(F.col("_uid")) & (F.col("_hash") == F.col("_of")))
    nth = F.row_number().over(Window.partitionBy("_uid", "_of").orderBy("_hash"))
    return found.withColumn("_nth", nth).filter("_nth <= _times").select(*rows.columns)


def build_samples(pairs: DataFrame, text_length: Column | None = None) -> DataFrame:
    """pairs(uid, path, text, duration_s) to chat samples; a missing duration is an error row.

    ``text_length`` is the caller's token count; the default is the number of characters.
    """
    heard = F.concat(F.lit(TASK_TEXT + SPEECH_OPEN), F.col("path"), F.lit(SPEECH_CLOSE))

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    missing = F.col("duration_s").isNull()
    return pairs.select(
        "uid",
        F.when(
            ~missing,
            F.array(
                message("system", F.lit(SYSTEM_TEXT)), message("user", heard),
                message("assistant", F.col("text")),
            ),
        ).alias("messages"),
        F.when(~missing, T.frames("duration_s")).alias("speech_length"),
        F.when(~missing, text_length if text_length is not None else F.length("text")).cast("bigint").alias("text_length"),
        F.when(missing, F.concat(F.lit("WAV not found: "), F.col("path"))).alias("error"),
    )


def within_token_budget(samples: DataFrame, budget: int) -> DataFrame:
    """Samples whose audio tokens plus text fit the budget."""
    return samples.filter(T.audio_tokens("speech_length") + F.col("text_length") <= budget)


def dataset_summary(utterances: DataFrame) -> DataFrame:
    """Rows and minutes per split and over all (split NULL)."""
    return utterances.rollup("split").agg(
        F.count("*").alias("n"), (F.sum("duration_s") / 60).alias("minutes")
    )


def mixture(corpora: dict[str, DataFrame]) -> DataFrame:
    """Union of labelled corpora with a ``corpus`` column."""
    out = None
    for name, df in corpora.items():
        part = df.withColumn("corpus", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def mixture_counts(mixed: DataFrame) -> DataFrame:
    """Rows per corpus and in total (corpus NULL)."""
    return mixed.rollup("corpus").agg(F.count("*").alias("n"))


def error_sample(rows: DataFrame, order: list[str], shown: int = ERRORS_SHOWN) -> DataFrame:
    """The first errors with the totals: processed, failed and how many are not shown."""
    sums = rows.agg(
        F.count_if(F.col("error").isNull()).alias("processed"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )
    w = Window.orderBy(*order)  # a global top-k: each task passes on at most ``shown`` rows
    first = rows.filter("error is not null").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= shown)
    failed = sums.select("failed").scalar()
    return first.select(
        "rank", "error", sums.select("processed").scalar().alias("processed"), failed.alias("failed"),
        F.greatest(F.lit(0), failed - shown).alias("not_shown"),
    )


def throughput(progress: DataFrame) -> DataFrame:
    """progress(job, rows, elapsed_s) per batch to rows, seconds and rows per second per job."""
    return progress.groupBy("job").agg(
        F.sum("rows").alias("rows"), F.sum("elapsed_s").alias("elapsed_s"), F.count("*").alias("batches")
    ).withColumn("rows_per_s", F.col("rows") / F.greatest(F.col("elapsed_s"), F.lit(1e-9)))
