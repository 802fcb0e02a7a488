"""Sources and sinks of the evaluation corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import kept, small_or_shuffled

GOLDEN_SCHEMA = (
    "question string, gold_answer string, gold_contexts array<string>, question_type string, answer_facts array<array<string>>, "
    "metadata struct<source_chunk_ids: array<string>, source_documents: array<string>, hops: int, kind: string, written_by: string, built: string>"
)
# The file types accepted and their media types.
MIME = {
    ".pdf": "application/pdf",
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".html": "text/html",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".csv": "text/csv",
}
ACCEPTED = ("application/pdf", "text/plain", "text/markdown")


def read_corpus(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """SR1: a Parquet table, only the columns asked for."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan, dealt to all cores where it has fewer parts than there are cores: one row group is one task's work.

    Larger tables have more parts and stay as they are. Filters and columns are pushed through to the scan.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan._jdf.rdd().getNumPartitions() >= cores else scan.repartition(cores)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, lines numbered from 1. Parts of a file are counted and numbered each by a task of its own."""
    part = ["file", "block"]
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    sizes = lines.groupBy(*part).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    inside = F.row_number().over(Window.partitionBy(*part).orderBy("id"))
    return lines.withColumn("at", inside).join(sizes.select(*part, before.alias("before")), part).select("file", (F.col("before") + F.col("at")).cast("int").alias("line"), "value")


def read_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SR2: golden samples and rejected lines of JSONL files.

    good: the samples with file and line; bad: (file, line, reason) for invalid JSON,
    lines without a question and, with line 0, files without any sample. Blank lines
    are skipped. Lines of one file are numbered in the order they stand in it.
    """
    rows = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = rows.withColumn("valid", F.try_parse_json("value").isNotNull()).withColumn("s", F.from_json("value", GOLDEN_SCHEMA))
    asked = F.coalesce(F.length(F.trim("s.question")), F.lit(0)) > 0
    reason = F.when(~F.col("valid"), "invalid JSON").when(~asked, "missing question")
    parsed = parsed.withColumn("reason", reason)
    good = parsed.where("reason is null").select("file", "line", "s.*")
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    empty = files.join(good.select("file").distinct(), "file", "left_anti").select("file", F.lit(0).alias("line"), F.lit("no samples").alias("reason"))
    return good, parsed.where("reason is not null").select("file", "line", "reason").unionByName(empty)


def read_beir(corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SR3: corpus as title and text, stripped, blanks dropped; relevant sets of the queries present; those queries."""
    text = F.trim(F.concat_ws("\n", "title", "text"))
    docs = corpus.select("doc_id", text.alias("content")).where("content != ''")
    known = qrels.join(queries.select("query_id"), "query_id", "left_semi")
    relevant = known.groupBy("query_id").agg(F.sort_array(F.collect_set("doc_id")).alias("relevant"))
    return docs, relevant, queries.join(relevant.select("query_id"), "query_id", "left_semi")


def mime_col(path: Column | str) -> Column:
    """SR5: media type by suffix, octet-stream if unknown."""
    path = F.col(path) if isinstance(path, str) else path
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))), F.lit("application/octet-stream"))


def intake_reason_col(path: Column, size: Column, max_mb: float) -> Column:
    """Why a file is rejected, null if it is accepted."""
    return (
        F.when(~mime_col(path).isin(*ACCEPTED), "unsupported type")
        .when(size == 0, "empty file")
        .when(size > int(max_mb * 1024 * 1024), "too large")
    )


def intake(spark: SparkSession, glob: str, max_mb: float = 50) -> DataFrame:
    """SR4: (path, length, mime_type, accepted, reason); file contents are not read.

    The reader passes over files without a byte, so the file system lists those.
    """
    files = spark.read.format("binaryFile").load(glob).select("path", "length")
    at = spark._jvm.org.apache.hadoop.fs.Path(glob)
    listed = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    bare = [(f.getPath().toString(), 0) for f in listed if f.isFile() and f.getLen() == 0]
    files = files.unionByName(spark.createDataFrame(bare, "path string, length long"))
    reason = intake_reason_col(F.col("path"), F.col("length"), max_mb)
    return files.select("path", "length", mime_col("path").alias("mime_type"), reason.isNull().alias("accepted"), reason.alias("reason"))


_NAME = r'"((?:[^"\\]|\\.)*)"\s*:'


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def _result_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, value, q, heads, inside, depth): a JSON file cut at its commas, the pieces numbered from 1.

    q counts a piece's quotes, heads the pieces with quotes so far; inside: the piece begins within
    a string; depth: braces opened and not closed by the pieces without quotes before it. Every part
    of a file adds up its own pieces; only one row of sums per part is ordered across the file.
    """
    part = ["file", "block"]
    rows = spark.read.text(path, lineSep=",").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    rows = rows.withColumn("q", _count(F.regexp_replace("value", r"(?s)\\\\.", ""), '"'))
    upto = Window.partitionBy(*part).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("quotes", F.sum("q").over(upto) - F.col("q"))
    braces = F.when(F.col("q") == 0, _count(F.col("value"), "{") - _count(F.col("value"), "}")).otherwise(0)
    odd = F.col("quotes") % 2 == 1  # as if the part began outside a string; braces within strings are none
    rows = rows.withColumn("even_b", F.when(~odd, braces).otherwise(0)).withColumn("odd_b", F.when(odd, braces).otherwise(0))
    sums = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"), F.count_if(F.col("q") > 0).alias("h"), F.sum("even_b").alias("e"), F.sum("odd_b").alias("o"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    sums = sums.select(*part, before("n").alias("n0"), before("q").alias("q0"), before("h").alias("h0"), "e", "o")
    turned = F.col("q0") % 2 == 1
    sums = sums.withColumn("b", F.when(turned, F.col("o")).otherwise(F.col("e"))).select(*part, "n0", "q0", "h0", before("b").alias("b0"))
    own = F.when(turned, F.col("odd_b")).otherwise(F.col("even_b"))
    return rows.join(sums, part).select(
        "file", (F.row_number().over(Window.partitionBy(*part).orderBy("id")) + F.col("n0")).alias("at"), "value", "q",
        (F.sum(F.when(F.col("q") > 0, 1).otherwise(0)).over(upto) + F.col("h0")).alias("heads"),
        ((F.col("quotes") + F.col("q0")) % 2 == 1).alias("inside"), (F.sum(own).over(upto) - own + F.col("b0")).alias("depth"),
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """SR6: result files mode -> per_query -> metric -> values (or mode -> metric -> values), as (mode, metric, pos, value).

    A file is cut at its commas, so a long array is read by as many tasks as the file
    has parts. Names (one row for each in the file) are put together again where they
    hold commas, and give mode and metric to the values that follow them. Other
    figures of a mode are passed over, null values kept, empty arrays give no row.
    """
    pieces = kept(_result_pieces(spark, path), "result-pieces")
    in_file = Window.partitionBy("file").orderBy("at")
    heads = pieces.where("inside or q > 0").withColumn("unit", F.sum(F.when(~F.col("inside"), 1).otherwise(0)).over(in_file))
    joined = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]))
    heads = heads.groupBy("file", "unit").agg(joined.alias("text"), F.max("at").alias("at"), F.max("heads").alias("heads"), F.min_by("depth", "at").alias("plain"))
    bare = F.regexp_replace("text", r'"(?:[^"\\]|\\.)*"', "")
    own = _count(bare, "{") - _count(bare, "}")
    # names stand one inside the next, the first of them behind the braces that the unit begins with
    start = F.col("plain") + F.sum(own).over(in_file) - own + _count(F.regexp_extract(bare, r"^[\s{]*", 0), "{")
    heads = heads.select("file", "at", "heads", "text", F.regexp_extract_all("text", F.lit(_NAME), F.lit(1)).alias("names"), start.cast("int").alias("start"))
    name_at = lambda level: F.when(F.col("start") <= level, F.get("names", level - F.col("start")))
    # a name of an outer level ends what the inner ones said
    heads = heads.withColumn("mode", F.last(name_at(1), ignorenulls=True).over(in_file)).withColumn("section", F.last(name_at(2), ignorenulls=True).over(in_file))
    array = F.regexp_extract("text", _NAME + r"\s*\[\s*([^\s\]]*)[\s\]}]*$", 2)
    level = F.col("start") + F.size("names") - 1
    plain = lambda c: F.from_json(F.concat(F.lit('["'), c, F.lit('"]')), "array<string>")[0]
    is_array = F.col("text").rlike(_NAME + r"\s*\[[^\[]*$") & ((level == 2) | ((level == 3) & (F.col("section") == "per_query")))
    heads = heads.where(is_array).select("file", "heads", F.col("at").alias("from"), array.alias("first"), plain(F.col("mode")).alias("mode"), plain(F.get("names", F.size("names") - 1)).alias("metric"))
    found = pieces.select("file", "at", "heads", "value").join(small_or_shuffled(kept(heads, "result-names")), ["file", "heads"]).where("at >= from")
    text = F.when(F.col("at") == F.col("from"), F.col("first")).otherwise(F.regexp_extract("value", r"^\s*([^\s\]}]*)", 1))
    return found.select("mode", "metric", (F.col("at") - F.col("from")).cast("int").alias("pos"), text.alias("_text")).where("_text != ''").select("mode", "metric", "pos", F.expr("try_cast(_text AS double)").alias("value"))


def write_chunks(chunks: DataFrame, path: str, partition_by: str | None = None) -> int:
    """SK1: store chunks as Parquet; refuses a table with an all-zero vector. Returns the rows written."""
    zero = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x != 0)
    bad = chunks.where(zero).count()
    if bad:
        raise ValueError(f"{bad} chunks have an all-zero embedding")
    if partition_by:
        chunks.repartition(partition_by).write.mode("append").partitionBy(partition_by).parquet(path)
    else:
        chunks.write.mode("append").parquet(path)
    return chunks.count()


def write_jsonl(df: DataFrame, path: str) -> None:
    """SK2: one JSON object per line; nulls left out."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """SK3: CSV with a header."""
    df.write.mode("overwrite").csv(path, header=True)


def result_table(rows: DataFrame) -> DataFrame:
    """(mode, metric, pos, value) as one row per mode: metric -> values in order of pos."""
    per = rows.groupBy("mode", "metric").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("values"))
    return per.groupBy("mode").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "values")))).alias("metrics"))


def write_results(rows: DataFrame, path: str) -> None:
    """SK4: per-query values and their means, one JSON object per mode."""
    means = rows.groupBy("mode").agg(F.count_distinct("pos").alias("n"))
    result_table(rows).join(means, "mode").write.mode("overwrite").json(path)


def write_result_files(rows: DataFrame, path: str) -> None:
    """Result files as SR6 reads them, one per mode: n and per_query. Values pass as rows, no array is held.

    rows: (mode, metric, pos, value), pos unique within a mode and metric.
    """
    rows = kept(rows.select("mode", "metric", "pos", "value"), "result-rows")
    ends = rows.groupBy("mode", "metric").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count(F.lit(1)).alias("n"))
    around = Window.partitionBy("mode")
    ends = ends.select("*", F.min("metric").over(around).alias("first"), F.max("metric").over(around).alias("last"), F.max("n").over(around).alias("most"))
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    opening = F.concat(F.lit("{"), quoted("mode"), F.lit(': {"n": '), F.col("most").cast("string"), F.lit(', "per_query": {'))
    head = F.concat(F.when(F.col("metric") == F.col("first"), opening).otherwise(F.lit(", ")), quoted("metric"), F.lit(": ["))
    tail = F.when(F.col("pos") == F.col("hi"), F.when(F.col("metric") == F.col("last"), F.lit("]}}}")).otherwise(F.lit("]"))).otherwise(F.lit(""))
    line = F.concat(F.when(F.col("pos") == F.col("lo"), head).otherwise(F.lit(", ")), F.coalesce(F.col("value").cast("string"), F.lit("null")), tail)
    lines = rows.join(small_or_shuffled(kept(ends, "result-ends")), ["mode", "metric"]).withColumn("line", line)
    lines.repartition("mode").sortWithinPartitions("mode", "metric", "pos").select(F.col("line").alias("value"), "mode").write.partitionBy("mode").text(path)


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("_n", place).where("_n = 1").drop("_n")
