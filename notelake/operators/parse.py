"""The two note parsers. They read the same text differently on purpose; neither is built on the other."""

from __future__ import annotations

import re
from collections import Counter
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notelake.functions.text import FENCE, lines, rule, strip, title_tokens, words

_KEYS = ("keywords", "aliases", "related")
_TOKEN = re.compile("[A-Za-z0-9]{3,}")


def split_frontmatter(notes: DataFrame) -> DataFrame:
    """Adds has_frontmatter, block (lines between the rules) and body. Only texts that begin with a rule are cut into lines."""
    n = notes.withColumn("_l", F.when(F.rlike("content", F.lit(r"(?U)^\s*---")), lines(F.col("content"))))
    rest = F.slice("_l", F.lit(2), F.size("_l"))
    n = n.withColumn("_end", F.when(strip(F.get("_l", F.lit(0))) == "---", F.array_position(F.transform(rest, rule), F.lit("---"))).otherwise(F.lit(0)))
    has = F.coalesce(F.col("_end") > 0, F.lit(False))
    return n.withColumns({
        "has_frontmatter": has,
        "block": F.when(has, F.slice("_l", F.lit(2), F.col("_end").cast("int") - 1)).otherwise(F.array().cast("array<string>")),
        "body": F.when(has, F.array_join(F.slice("_l", F.col("_end").cast("int") + 2, F.size("_l")), "\n")).otherwise(F.col("content")),
    }).drop("_l", "_end")


def frontmatter(block: Column) -> Column:
    """struct<keywords, aliases, related> of arrays; a key that is absent or empty is null. Lines are `key: value`, `key: [a, b]` or `- item`;
    an unknown key ends the current one."""
    zero = F.struct(F.lit("").alias("key"), *[F.array().cast("array<string>").alias(k) for k in _KEYS])

    def step(a: Column, line: Column) -> Column:
        x = strip(line)
        item = x.startswith("-")
        key = F.when(item, a["key"]).when(x.contains(":"), strip(F.substring_index(x, ":", 1))).otherwise(a["key"])
        raw = F.when(item, strip(F.substring(x, 2, 1 << 30))).when(x.contains(":"), strip(F.substring(x, F.instr(x, ":") + F.lit(1), F.lit(1 << 30)))).otherwise("")
        many = F.when(raw.startswith("[") & raw.endswith("]"), F.split(F.substring(raw, F.lit(2), F.length(raw) - 2), ",")).otherwise(F.array(raw))
        got = F.filter(F.transform(many, strip), lambda v: v != "")
        return F.struct(F.when(key.isin(*_KEYS), key).otherwise("").alias("key"), *[F.when(key == k, F.concat(a[k], got)).otherwise(a[k]).alias(k) for k in _KEYS])

    full = lambda v: F.when(F.size(v) > 0, F.array_distinct(v))
    return F.aggregate(block, zero, step, lambda a: F.struct(*[full(a[k]).alias(k) for k in _KEYS]))


def links_v2(body: Column) -> Column:
    """Link targets in order, with repetitions: alias, heading and `.md` cut off, empty ones dropped."""
    raw = F.regexp_extract_all(body, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))
    clean = F.transform(raw, lambda x: strip(F.split_part(F.split_part(strip(x), F.lit("|"), F.lit(1)), F.lit("#"), F.lit(1))))
    return F.transform(F.filter(clean, lambda x: x != ""), lambda x: F.regexp_replace(x, r"(?i)\.md$", ""))


def top_terms(body: Column, terms: int) -> Column:
    """The most frequent tokens of each text (as tokens(); count desc, term asc). They are counted where the text is, so neither texts nor words are shuffled."""

    @F.arrow_udf("array<string>")
    def best(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            found: Counter[str] = Counter()
            for word, k in Counter(_TOKEN.findall(text.as_py() or "")).items():
                found[word.lower()] += k
            out.append([w for w, _ in nsmallest(terms, found.items(), key=lambda x: (-x[1], x[0]))])
        return pa.array(out, pa.list_(pa.string()))

    return best(body)


def parse_v2(notes: DataFrame, terms: int = 30) -> DataFrame:
    """notes (vault, rel_path, title, content) with front-matter, links, title tokens and the top terms (count desc, term asc)."""
    n = split_frontmatter(notes)
    n = n.withColumns({"frontmatter": frontmatter(F.col("block")), "links": links_v2(F.col("body")), "title_tokens": title_tokens(F.col("title"))}).withColumn("link_set", F.array_distinct("links"))
    return n.withColumn("top_terms", top_terms(F.col("body"), terms))


def links_v1(content: Column) -> Column:
    """Distinct targets anywhere in the file; empty ones stay."""
    raw = F.regexp_extract_all(content, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    return F.array_distinct(F.transform(raw, lambda x: strip(F.split_part(F.split_part(x, F.lit("|"), F.lit(1)), F.lit("#"), F.lit(1)))))


def parse_v1(notes: DataFrame) -> DataFrame:
    """One row a title of a vault (of equal titles the largest path wins): vault, name, outgoing, tags, word_count and the other columns. Texts are
    parsed before the rows of a title meet, so only the columns that are asked for are shuffled, and one row a title and task."""
    n = notes.withColumnRenamed("title", "name").withColumns({
        "vault": F.coalesce("vault", F.lit("")), "outgoing": links_v1(F.col("content")),
        "tags": F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?U)#([\w\-/]+)"), F.lit(1))),
        "word_count": F.size(words(F.regexp_replace("content", FENCE, ""))).cast("long"),
    })
    last = W.partitionBy("vault", "name").orderBy(F.desc("rel_path"))
    return n.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def path_penalty(left: Column, right: Column, penalty: float = 0.9) -> Column:
    """Factor for notes of different top folders; a note at the root is its own folder."""
    top = lambda p: F.split_part(p, F.lit("/"), F.lit(1))
    return F.when(top(left) != top(right), F.lit(penalty)).otherwise(F.lit(1.0))


def encoding(files: DataFrame) -> DataFrame:
    """One row of counts: bom, non_utf8 and the end-of-line classes none, mixed, crlf, lf."""
    text = F.col("content").cast("string")
    crlf = (F.length("content") - F.octet_length(F.replace(text, F.lit("\r\n"), F.lit("")))) / 2
    lf = F.length("content") - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) - crlf
    c = files.select(F.hex(F.substring("content", 1, 3)).alias("head"), F.is_valid_utf8(text).alias("ok"), crlf.alias("crlf"), lf.alias("lf"))
    return c.agg(
        F.count_if(F.col("head") == "EFBBBF").alias("bom"), F.count_if(~F.col("ok")).alias("non_utf8"), F.count_if(F.expr("crlf = 0 and lf = 0")).alias("eol_none"),
        F.count_if(F.expr("crlf > 0 and lf > 0")).alias("eol_mixed"), F.count_if(F.expr("crlf > 0 and lf = 0")).alias("eol_crlf"), F.count_if(F.expr("crlf = 0 and lf > 0")).alias("eol_lf"),
    )
