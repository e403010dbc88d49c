"""Texts and records from files: plain texts, catalogues in CSV, JSON and XML, dumps, and what a file is."""

from __future__ import annotations

import bz2
import html.parser
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

#: First bytes of a file, in hexadecimal, and what they mean; fixed values.
MAGIC = (("25504446", "application/pdf"), ("504B0304", "application/zip"), ("1F8B", "application/gzip"), ("425A68", "application/x-bzip2"), ("3C3F786D6C", "application/xml"), ("EFBBBF", "text/plain"), ("7F454C46", "forbidden"), ("4D5A", "forbidden"))
#: Elements of a page that hold no text of it; fixed values.
DROPPED = ("script", "style", "noscript", "nav", "header", "footer", "aside", "form", "svg", "iframe")
_BLOCKS = {"p", "div", "section", "article", "li", "ul", "ol", "table", "tr", "br", "hr", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, text)`` of all .txt, .md and .markdown files below a folder."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md,markdown}").text(folder, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def source_type(path: Column) -> Column:
    """What kind of source a file name tells of; the first that fits."""
    name = F.lower(F.regexp_replace(path, r"^.*[/\\]", ""))
    out = F.when(name.contains("quran"), "quran")
    for word in ("bible", "redflags", "manifesto"):
        out = out.when(name.contains(word), word)
    return out.otherwise("book")


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON files, each a list or an object with ``entries``; files that aren't JSON give none."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("v"))
    both = raw.select("path", F.when(F.col("v").startswith("["), F.from_json("v", f"array<struct<{schema}>>")).otherwise(F.from_json("v", f"struct<entries: array<struct<{schema}>>>")["entries"]).alias("r"))
    return both.select("path", F.explode("r").alias("r")).select("path", "r.*")


def csv_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue in CSV; authors and subjects are split at semicolons."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    parts = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return raw.withColumns({c: parts(c) for c in ("Authors", "Subjects") if c in raw.columns})


def xml_records(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Records of XML files, one for each element ``row_tag``; a file with a document type is refused.

    The check reads the files once more, as text, so that no entity is ever
    expanded.
    """
    bad = spark.read.text(path, wholetext=True).where(F.col("value").rlike(r"<!(DOCTYPE|ENTITY)"))
    if bad.limit(1).count():
        raise ValueError("a file declares a document type or entities")
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def best_file(files: Column) -> Column:
    """Of an array of ``(name, format, size)`` the best derivative: plain text first, then larger, then by name."""
    rank = lambda f: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in (("txt", 0), ("html", 1), ("epub", 2), ("xml", 3), ("pdf", 6)) for x in p]), F.lower(f["format"])), F.lit(9))
    usable = F.filter(files, lambda f: ~f["name"].rlike(r"(?i)(_meta|_files|_djvu\.xml|\.torrent|\.sqlite)"))
    order = F.array_sort(F.transform(usable, lambda f: F.struct(rank(f).alias("r"), (-f["size"]).alias("s"), f["name"].alias("n"), f.alias("f"))))
    return F.try_element_at(order, F.lit(1))["f"]


def ordered_text(pages: DataFrame, key: str, position: str, text: str) -> DataFrame:
    """``(key, text)``: a document's pages joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("text"))


@F.pandas_udf(StringType())
def without_templates(s: pd.Series) -> pd.Series:
    """Wiki markup without its templates, however deep they lie in one another; an unclosed one stays."""

    def one(t: str | None) -> str | None:
        if t is None or "{{" not in t:
            return t
        kept: list[list[str]] = [[]]  # what is kept so far, outside and within each open template
        at = 0
        for m in re.finditer(r"\{\{|\}\}", t):
            kept[-1].append(t[at : m.start()])
            at = m.end()
            if m[0] == "{{":
                kept.append([])
            elif len(kept) > 1:
                kept.pop()
            else:
                kept[0].append("}}")
        kept[-1].append(t[at:])
        return "{{".join("".join(x) for x in kept)

    return s.map(one)


def clean_wikitext(c: Column) -> Column:
    """Wiki markup as text: without templates, notes, tables, links and emphasis."""
    t = without_templates(F.regexp_replace(c, r"(?s)<!--.*?-->|<ref[^>]*/>|<ref[^>]*>.*?</ref>", ""))
    t = F.regexp_replace(t, r"(?s)\{\|.*?\|\}", "")
    t = F.regexp_replace(t, r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", "$1")
    t = F.regexp_replace(t, r"\[https?://\S+ ?([^\]]*)\]", "$1")
    t = F.regexp_replace(t, r"'{2,}|</?[a-zA-Z][^>]*>", "")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def dump_reason(title: Column, namespace: Column, text: Column, redirect: Column, least: int = 400) -> Column:
    """Why a page of a dump isn't taken; null if it is."""
    return F.when(F.coalesce(redirect, F.lit(False)), "redirect").when(namespace != 0, "namespace").when(F.lower(text).rlike(r"<pages\s+index="), "transclusion").when(F.length(clean_wikitext(text)) < least, "short").when(title.contains("/"), "subpage")


def dump_index(lines: DataFrame) -> DataFrame:
    """``(offset, page_id, title)`` of index lines ``offset:page_id:title``; a title may hold colons."""
    p = F.split("value", ":", 3)
    return lines.where(F.col("value").rlike(r"^\d+:\d+:")).select(p[0].cast("long").alias("offset"), p[1].cast("long").alias("page_id"), p[2].alias("title"))


def byte_ranges(index: DataFrame, size: int | None = None, block: int = 1 << 30) -> DataFrame:
    """``(start, end, pages)``: the streams of a dump, ends included; the last only if the size is known.

    The next start is looked for within a block of the file, and for a
    block's last stream among the blocks' first ones.
    """
    per = index.groupBy(F.col("offset").alias("start")).agg(F.count("*").alias("pages")).withColumn("b", F.floor(F.col("start") / block))
    firsts = per.groupBy("b").agg(F.min("start").alias("f"))
    after = firsts.select("b", F.lead("f").over(Window.orderBy("b")).alias("f"))  # a row a block of the file
    end = F.coalesce(F.lead("start").over(Window.partitionBy("b").orderBy("start")), F.col("f")) - 1
    out = per.join(after, "b", "left").withColumn("end", F.coalesce(end, F.lit(size - 1 if size else None).cast("long")))
    return out.where("end is not null").select("start", "end", "pages")


def decompressed(data: bytes) -> bytes:
    """A bzip2 stream, or several one after another, to their ends; an error if the last one breaks off."""
    out = []
    while data:
        d = bz2.BZ2Decompressor()
        out.append(d.decompress(data))
        if not d.eof:
            raise ValueError("the stream breaks off")
        data = d.unused_data
    return b"".join(out)


def read_streams(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """``(start, text)``: each stream of a bzip2 dump decompressed to its end by a task of its own; the path must be one all executors share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            with open(path, "rb") as f:
                for a, z in zip(b["start"], b["end"]):
                    f.seek(a)
                    yield pd.DataFrame({"start": [a], "text": [decompressed(f.read(z - a + 1)).decode("utf-8", "replace")]})

    return ranges.select("start", "end").repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "start long, text string")


def mime(content: Column) -> Column:
    """What a file's first bytes say it is; ``forbidden`` for programs; text or HTML for what else is valid UTF-8."""
    head = F.hex(F.substring(content, 1, 16))
    out = None
    for sign, name in MAGIC:
        out = F.when(head.startswith(sign), name) if out is None else out.when(head.startswith(sign), name)
    looks = F.lower(F.substring(content.cast("string"), 1, 256)).rlike(r"<(!doctype html|html|body|head)")
    return out.when(looks, "text/html").otherwise("text/plain")


class _Text(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in DROPPED
        if tag in _BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in DROPPED and self.skip > 0
        if tag in _BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


@F.pandas_udf(StringType())
def html_text(s: pd.Series) -> pd.Series:
    """A page's text without its furniture; blocks on lines of their own."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        p = _Text()
        p.feed(x)
        p.close()
        lines = (re.sub(r"[ \t\r\f\v ]+", " ", y).strip() for y in "".join(p.out).split("\n"))
        return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()

    return s.map(one)


def content_signal(robots: DataFrame, host: str, text: str) -> DataFrame:
    """``(host, name, allowed)``: content signals of the group for all agents; the last of a name counts, an unknown value is null."""
    lines = robots.select(host, F.posexplode(F.split(text, r"\r?\n")).alias("i", "line")).select(host, "i", F.lower(F.trim(F.regexp_replace("line", "#.*$", ""))).alias("line"))
    agent = F.col("line").startswith("user-agent:")
    w = Window.partitionBy(host).orderBy("i")
    marked = lines.where("line != ''").withColumn("a", agent).withColumn("g", F.sum(F.when(agent & ~F.coalesce(F.lag(agent).over(w), F.lit(False)), 1).otherwise(0)).over(w))
    every = marked.where(agent & F.col("line").rlike(r"^user-agent:\s*\*$")).select(host, "g").distinct()
    own = marked.join(every, [host, "g"], "left_semi").where(F.col("line").startswith("content-signal:"))
    parts = own.select(host, "i", F.posexplode(F.split(F.regexp_replace("line", "^content-signal:", ""), ",")).alias("j", "p"))
    pair = parts.select(host, "i", "j", F.trim(F.substring_index("p", "=", 1)).alias("name"), F.trim(F.substring_index("p", "=", -1)).alias("v")).where("name != ''")
    return pair.groupBy(host, "name").agg(F.max_by(F.when(F.col("v") == "yes", True).when(F.col("v") == "no", False), F.struct("i", "j")).alias("allowed"))


def write_sharded(df: DataFrame, path: str, digest: str) -> None:
    """Appends rows whose digest isn't stored yet, in folders by its first four digits."""
    spark = df.sparkSession
    try:
        known = spark.read.parquet(path).select(digest)
        df = df.join(known, digest, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
    df.dropDuplicates([digest]).withColumn("shard1", F.substring(digest, 1, 2)).withColumn("shard2", F.substring(digest, 3, 2)).write.mode("append").partitionBy("shard1", "shard2").parquet(path)


def write_jsonl(df: DataFrame, path: str, order: str, since: object = None) -> None:
    """Rows as lines of JSON, those whose ``order`` is greater than ``since`` if that is given; a part a task, each in order."""
    rows = df if since is None else df.where(F.col(order) > F.lit(since))
    rows.repartitionByRange(order).sortWithinPartitions(order).select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def with_sidecar(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(name, content)`` of two files for each row: its text, and beside it what else is known of it, as JSON with the text's hash."""
    told = F.to_json(F.struct(*[c for c in df.columns if c != text], F.sha2(F.coalesce(text, F.lit("")), 256).alias("sha256"), F.length(F.coalesce(text, F.lit(""))).alias("chars")))
    files = F.array(F.struct(F.concat(F.col(key).cast("string"), F.lit(".txt")).alias("name"), F.coalesce(text, F.lit("")).alias("content")), F.struct(F.concat(F.col(key).cast("string"), F.lit(".json")).alias("name"), told.alias("content")))
    return df.select(F.explode(files).alias("f")).select("f.name", "f.content")
