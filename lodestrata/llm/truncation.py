"""Text cut off by field limits or in transfer.

A self-join by prefix finds every text of which a longer copy exists, without comparing pairs: prefixes of
fixed lengths are hashed, only texts that share one with another text are sorted by value, and there a strict
prefix stands directly before a longer copy. Most cut texts have no longer copy in a corpus, so more signs, all
measured on the whole corpus, decide with it: lengths at which a source's texts pile up (its field limits), the
last lines that many different texts share (closings), what else a source's endings of one kind look like, and
how the text itself ends.

Each text is read once, in one map task; what is judged later are its measures, not the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.ids import id16
from lodestrata.llm.syntax import fault
from lodestrata.operators.skew import hot_keys, skew_join
from lodestrata.runtime import BROADCAST_LIMIT_BYTES, materialize, stored_bytes

#: A last line closes texts when this share of the distinct texts, and at least CLOSING_TEXTS, end with it:
#: there are never more than 1 / CLOSING_SHARE such lines.
CLOSING_SHARE = 0.001
CLOSING_TEXTS = 2
#: A length is a source's limit when this share of its distinct texts, and so many, have it (more of them where
#: longer texts exist: a few of one length may be chance), and when it stands out: LIMIT_PEAK times the texts of any length up to LIMIT_NEAR from it. There are at most 1 / LIMIT_SHARE.
LIMIT_SHARE = 0.02
LIMIT_TEXTS = 3
LIMIT_INNER = 10
LIMIT_PEAK = 3
LIMIT_NEAR = 8
#: Bytes that a limit in bytes may fall short by, where a character of several bytes was dropped whole.
BYTE_SLACK = 3
#: Endings of one kind in one source need no stop when so many distinct texts have them (those at a limit not
#: counted), this share without one.
OPEN_TEXTS = 10
OPEN_SHARE = 0.5
#: A text of one line, of at most so many words and without a stop, is a title.
TITLE_WORDS = 7
#: Length of the shortest hashed prefix; the others double. Shorter texts are compared with prefixes of this length.
PREFIX = 64
#: Texts of one task of the sort by value.
TEXTS_PER_TASK = 200_000

#: Marks that are put after a cut.
MARK = re.compile(r"\s*(?:…|\.{3}|\[(?:truncated|cut|more|snip|…|\.{3})\]|\((?:truncated|cut|more|continued|…|\.{3})\)|<(?:truncated|snip|cut)>)$", re.I)
#: The end of a sentence, with what may close after it.
STOP = re.compile(r"""(?:[.!?。！？])["'»”’)\]`*_]*$""")
#: A number whose point ends the text: the digits after it are gone.
OPEN_NUMBER = re.compile(r"\d\.$")
#: Last lines that close a text by their form, for corpora too small to measure: signatures, bracketed notes, trailers, a lone code span.
FORMS = re.compile(r"(?:(?:--|—|–) \S.*|\([^()]*\)|[A-Z][\w-]*: \S+(?: \S+){0,2}|`[^`]+`|```)$")
#: Text that may be source code: it is judged by the languages' lexers.
CODE_LINE = re.compile(r"^\s*(?:[}\])]+[;,]?|.*[{;,(\[]|(?:pub|use|fn|let|def|class|import|package|from|return|val|var|fun|if|for|match|impl|#|//)\b.*|[\w.-]+ = .*|\[+[\w.-]+\]+|\"[^\"]+\": .*)$")
#: An address that ends a text: nothing tells whether it goes on.
ADDRESS = re.compile(r"\b[a-z][a-z0-9+.-]*://\S+$", re.I)
#: What begins a last line: a list item, a heading, a label.
ITEM = re.compile(r"(?:[-*+•–]|\d{1,3}[.)])\s+")
HEADING = re.compile(r"#{1,6}\s")
LABEL = re.compile(r"([^\W\d_][\w-]{0,30}):\s")
INNER_STOP = re.compile(r"[.!?]\s|[。！？]")


def last_line(text: str) -> str:
    """The last line of a text, digits masked."""
    return re.sub(r"\d+", "0", text.rstrip().rsplit("\n", 1)[-1].strip())


def without_mark(text: str) -> str:
    """A text without blanks and a cut's mark at its end."""
    return MARK.sub("", text.rstrip()).rstrip()


def looks_like_code(text: str) -> bool:
    lines = [x for x in text.splitlines() if x.strip()]
    return bool(lines) and sum(bool(CODE_LINE.match(x)) for x in lines) >= 0.6 * len(lines)


def parses(text: str) -> bool:
    """Whether a text is valid source code of a known language."""
    return any(fault(text, lang) is None for lang in ("rust", "python", "kotlin", "json", "toml"))


def ending_kind(bare: str) -> str:
    """What kind of ending a text has: its last line's marker or label, and whether other sentences stand in it."""
    last = bare.rsplit("\n", 1)[-1].strip()
    label = LABEL.match(last)
    mark = "-" if ITEM.match(last) else "#" if HEADING.match(last) else re.sub(r"\d+", "0", label.group(1)) + ":" if label else ""
    return f"{mark}|{'s' if INNER_STOP.search(last) else ''}|{'' if chr(10) in bare else '1'}"


def open_list(bare: str) -> bool:
    """Whether the last line is an item of a list whose other items, of which there are some, end without a stop."""
    *above, last = [x.strip() for x in bare.splitlines() if x.strip()]
    others = [x for x in above if ITEM.match(x)]
    return bool(ITEM.match(last) and others) and not any(STOP.search(x) for x in others)


#: What is measured of a text that is not blank; ``plain`` is how it ends by itself: stop, open or code.
MEASURES = "bare binary, bare_chars long, chars long, bytes long, closing long, kind string, lines boolean, marked boolean, stop boolean, broken boolean, code boolean, parsed boolean, worded boolean, form boolean, begin string, prefixes array<bigint>"


def measure(text: str) -> tuple | None:
    """The MEASURES of a text; None of a blank one."""
    end = text.rstrip()
    if not end.strip():
        return None
    closing = last_line(end)
    marked = MARK.search(end) is not None
    bare = without_mark(text)
    stop = STOP.search(end) is not None
    code = looks_like_code(end)
    last = end.rsplit("\n", 1)[-1].strip()
    form = (
        ADDRESS.search(last) is not None or ("\n" in end and FORMS.match(last) is not None) or open_list(end)
        or ("\n" not in end.strip() and len(end.split()) <= TITLE_WORDS and not INNER_STOP.search(end))
    )
    return (
        xxhash.xxh3_128_digest(bare.encode("utf-8", "surrogatepass")), len(bare), len(text), len(text.encode("utf-8", "surrogatepass")), xxhash.xxh3_64_intdigest(closing.encode("utf-8", "surrogatepass")) - (1 << 63),
        ending_kind(end), "\n" in end, marked, stop, OPEN_NUMBER.search(end) is not None or last.count("`") % 2 == 1, code, code and parses(end), re.search(r"\w", closing) is not None,
        form and not marked and not HEADING.match(last), bare[:PREFIX],
        [xxhash.xxh3_64_intdigest(bare[: PREFIX << i].encode("utf-8", "surrogatepass"), seed=i) - (1 << 63) for i in range((len(bare) // PREFIX).bit_length())],
    )


def whole_column(closes: Column, open_kind: Column) -> Column:
    """Whether a text, by its own end, is complete: from its MEASURES, whether its last line closes and its kind needs no stop.

    A lone delimiter closes many excerpts of code, but only what it is part of tells whether that is whole.
    """
    c = F.col
    return (
        F.when(closes & c("lines"), ~c("code") | c("worded") | c("parsed")).when(c("marked"), False).when(c("stop"), True).when(c("code"), c("parsed")).otherwise(c("form") | (open_kind & ~c("kind").startswith("#")))
    )


def stopped_column(closes: Column) -> Column:
    """Whether a text whose end is a limit's, or that goes on elsewhere, still ends with a sentence."""
    c = F.col
    return ~c("broken") & c("stop") & (~c("marked") | closes) & (~c("code") | c("parsed"))


def strict_prefixes(texts: DataFrame) -> DataFrame:
    """``key`` of every ``text`` that is a strict prefix of another; ``texts`` has both, distinct.

    Values are range-partitioned and sorted; each task compares neighbours, since a strict prefix stands
    directly before a longer copy. The tasks' first and last values, two of each, are compared in the same way
    until one task holds them.
    """
    key = texts.schema["key"].dataType
    rows = texts.count()
    # each round leaves two rows of a task: with a few texts a task their number would not shrink
    n = 1 if rows <= max(TEXTS_PER_TASK, 16) else -(-rows // TEXTS_PER_TASK)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, kind = None, None, None
        for b in batches:
            kind = b.schema.field("key").type
            found = []
            for k, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                if last is None:
                    first = (k, t)
                elif len(t) > len(last[1]) and t.startswith(last[1]):
                    found.append(last[0])
                last = (k, t)
            yield pa.RecordBatch.from_arrays([pa.array(found, kind), pa.array([None] * len(found), pa.string())], names=["key", "text"])
        if last is not None and n > 1:
            yield pa.RecordBatch.from_arrays([pa.array([first[0], last[0]], kind), pa.array([first[1], last[1]], pa.string())], names=["key", "text"])

    spread = texts.select("key", "text")
    spread = spread.coalesce(1) if n == 1 else spread.repartitionByRange(n, "text")
    found = materialize(spread.sortWithinPartitions("text").mapInArrow(inside, f"key {key.simpleString()}, text string"), "prefixes")
    inner = found.where("text IS NULL").select("key")
    return inner if n == 1 else inner.unionByName(strict_prefixes(found.where("text IS NOT NULL").distinct())).distinct()


def with_longer_copy(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """``bare`` of the texts that are, without mark and outer end, strict prefixes of others, from all (key, text) ``rows``.

    ``seen``: key, bare, bare_chars, begin, prefixes of all texts. A text of at least PREFIX characters is looked for
    among those that share its longest hashed prefix; only these are read again and sorted. The shorter ones are
    sorted together with the distinct beginnings of all others, of PREFIX characters.
    """
    # short texts among the beginnings of all: a beginning that is a short text keeps that text's key
    values = seen.where("begin <> ''").groupBy(F.col("begin").alias("text")).agg(F.max(F.when(F.col("bare_chars") < PREFIX, F.col("bare"))).alias("key"))
    short = strict_prefixes(values).where("key IS NOT NULL").select(F.col("key").alias("bare"))
    # longer ones: groups of a prefix that is the longest hashed one of some text and belongs to several
    cut = seen.where(F.size("prefixes") > 0).select("bare", F.size("prefixes").alias("n"), F.posexplode("prefixes").alias("pos", "prefix"))
    groups = cut.groupBy("prefix").agg(F.min("bare").alias("a"), F.max("bare").alias("b"), F.bool_or(F.col("pos") == F.col("n") - 1).alias("own")).where("own AND a <> b").select("prefix")
    groups = materialize(groups, "groups")
    if not groups.head(1):
        return short
    of = seen.select("key", F.explode("prefixes").alias("prefix"))
    shared = of.join(F.broadcast(groups) if stored_bytes(groups) * 4 <= BROADCAST_LIMIT_BYTES else groups, "prefix", "left_semi").select("key").distinct()
    kept = materialize(shared, "shared")
    few = stored_bytes(kept) * 4 <= BROADCAST_LIMIT_BYTES

    def bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [without_mark(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts], pa.binary()), pa.array(texts, pa.string())], names=["key", "text"])

    whole = rows.select("key", "text").join(F.broadcast(kept) if few else kept, "key", "left_semi").dropDuplicates(["key"])
    long_texts = materialize(whole.select("key", "text").mapInArrow(bare, "key binary, text string").dropDuplicates(["key"]), "shared")
    return short.unionByName(strict_prefixes(long_texts).select(F.col("key").alias("bare"))).distinct()


def closing_lines(facts: DataFrame) -> set[int]:
    """Hashes of the last lines that close many different texts; ``facts`` has key and closing. At most 1/CLOSING_SHARE."""
    texts = facts.select("closing", "key").distinct()
    counts = texts.groupBy("closing").count()
    least = max(CLOSING_TEXTS, int(CLOSING_SHARE * (counts.agg(F.sum("count")).first()[0] or 0)))
    return {r["closing"] for r in counts.where(F.col("count") >= least).toLocalIterator()}


def field_limits(facts: DataFrame) -> DataFrame:
    """Per source its limits in characters and bytes (arrays; null: none seen), from source, key, chars, bytes."""
    out = None
    for unit in ("chars", "bytes"):
        n = facts.groupBy("source", F.col(unit).alias("size")).count()
        of = n.groupBy("source").agg(F.sum("count").alias("of"), F.max("size").alias("top"))
        w = Window.partitionBy("source").orderBy("size")
        near = F.greatest(F.coalesce(F.max("count").over(w.rangeBetween(-LIMIT_NEAR, -1)), F.lit(0)), F.coalesce(F.max("count").over(w.rangeBetween(1, LIMIT_NEAR)), F.lit(0)))
        peak = n.withColumn("near", near).join(of, "source").where((F.col("count") >= F.when(F.col("size") == F.col("top"), LIMIT_TEXTS).otherwise(LIMIT_INNER)) & (F.col("count") >= LIMIT_SHARE * F.col("of")) & (F.col("count") >= LIMIT_PEAK * F.col("near")))
        part = peak.groupBy("source").agg(F.collect_list("size").alias(f"{unit}_limits"))
        out = part if out is None else out.join(part, "source", "full_outer")
    return out


def at_limit_column() -> Column:
    """Whether a text is as long as a limit of its source; characters of several bytes may leave a few bytes free."""
    slack = F.when(F.col("bytes") > F.col("chars"), BYTE_SLACK).otherwise(0)
    return F.coalesce(F.array_contains("chars_limits", F.col("chars")), F.lit(False)) | F.coalesce(F.exists("bytes_limits", lambda x: F.col("bytes").between(x - slack, x)), F.lit(False))


def open_kinds(facts: DataFrame, closes: Column) -> DataFrame:
    """source, kind of the endings that mostly have no stop: what such a text needs no stop for either."""
    seen = facts.where(~closes & ~F.col("marked") & ~F.col("code") & ~at_limit_column())
    g = seen.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("stop"), 1)).alias("open"))
    return g.where((F.col("n") >= OPEN_TEXTS) & (F.col("open") >= OPEN_SHARE * F.col("n"))).select("source", "kind", F.lit(True).alias("open_kind"))


def judge_texts(docs: DataFrame, keep: list[str], text: str, source: str) -> DataFrame:
    """``keep``, source, cut (boolean), at_limit, has_longer of every row: whether its text was cut off.

    Null, empty and blank texts are not cut. A null source is a source of its own, named ''. Repeated texts
    count once in the statistics, which are taken over all rows. An empty table gives an empty result. The
    columns of ``keep`` may not be called source, cut, at_limit or has_longer.
    """
    rows = docs.select(*[F.col(c).alias(f"__keep_{c}") for c in keep], F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"), id16(F.col(text)).alias("key"))
    passed = [c for c in rows.columns if c != "text"]
    names = [m.split()[0] for m in MEASURES.split(", ")]
    types = [{"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}[m.split()[1]] for m in MEASURES.split(", ")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [None if t is None else measure(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in passed), *(pa.array([None if m is None else m[i] for m in found], t) for i, t in enumerate(types))], names=[*passed, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"), MEASURES])
    seen = materialize(rows.mapInArrow(look, schema), "measures")
    facts = materialize(seen.where("bare IS NOT NULL").drop("begin", "prefixes", *[c for c in passed if c.startswith("__keep_")]).dropDuplicates(["key", "source"]), "texts")
    closings = closing_lines(facts)
    closes = F.coalesce(F.col("closing").isin(list(closings)), F.lit(False)) if closings else F.lit(False)
    limits = materialize(field_limits(facts), "limits")
    longer = materialize(with_longer_copy(rows.where("text IS NOT NULL"), seen).withColumn("longer", F.lit(True)), "longer")

    def add(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        """A small table by broadcast; a larger one salted, as one source may hold a third of all rows."""
        if stored_bytes(right) * 4 <= BROADCAST_LIMIT_BYTES:
            return left.join(F.broadcast(right), on, "left")
        key = F.xxhash64(*on)
        one = left.withColumn("__on", F.when(F.concat(*[F.col(c).cast("string") for c in on]).isNotNull(), key))
        return skew_join(one, right.withColumn("__on", key).drop(*on), "__on", "left", hot_keys(one, F.col("__on")), F.col("key")).drop("__on")

    kinds = materialize(open_kinds(add(facts, limits, ["source"]), closes & F.col("lines")), "kinds")
    out = add(add(add(seen, longer, ["bare"]), limits, ["source"]), kinds, ["source", "kind"])
    at_limit = at_limit_column()
    has_longer = F.coalesce("longer", F.lit(False))
    cut = F.when(at_limit | has_longer, ~stopped_column(closes)).otherwise(~whole_column(closes, F.coalesce("open_kind", F.lit(False))))
    return out.select(*[F.col(f"__keep_{c}").alias(c) for c in keep], "source", F.coalesce(F.col("bare").isNotNull() & cut, F.lit(False)).alias("cut"), at_limit.alias("at_limit"), has_longer.alias("has_longer"))
