"""Log lines of unlike programs into entries with time, level, component and message.

The layouts are learned, not listed. A line is lexed into typed tokens (time stamps by their shape, levels,
numbers, keys before `=`, words, single marks). Masked heads are counted over all lines; heads that hold a time
stamp are the candidate templates, and a candidate's support decides how far the head reaches. The slots of a
template then take their field roles by type: the stamp is the time, a level token the level, the last word slot
before the message the component.

A candidate needs MIN_SUPPORT lines, however many lines there are. Candidates are counted in Spark, each by a
digest of its own and its parent's, and those that no growth can reach are dropped there; the rest, the heads
that may be headers, come to the driver.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.runtime import materialize, release

#: A head or an object's key is learned from so many lines, whatever their share.
MIN_SUPPORT = 3
#: A head goes on until so many of its tokens bring no bracket and no key; its first ones are looked at in any case.
HEAD_TOKENS = 20
#: A longer head is taken over a shorter one of the same layout from this share of its lines.
EXTEND = 0.6
#: Lines of a file that one task handles when entries are given their last line.
BLOCK = 100_000

#: Level words and their common names.
LEVELS = {
    "trace": "TRACE", "t": "TRACE", "debug": "DEBUG", "d": "DEBUG", "info": "INFO", "i": "INFO", "notice": "INFO", "information": "INFO",
    "warn": "WARN", "warning": "WARN", "w": "WARN", "error": "ERROR", "err": "ERROR", "e": "ERROR", "crit": "ERROR", "critical": "ERROR",
    "fatal": "ERROR", "f": "ERROR", "alert": "ERROR", "emerg": "ERROR", "panic": "ERROR",
}
MONTHS = {m: i + 1 for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}

ANSI = re.compile(r"\x1b\[[0-9;?]*[ -/]*[@-~]")
_ISO = r"(?P<iso>\d{4}-\d\d-\d\d(?P<sep>[T ])\d\d:\d\d:\d\d(?P<frac>[.,]\d{1,9})?(?P<zone>Z|[+-]\d\d:?\d\d)?)(?![\d:])"
_SLASH = r"(?P<slash>\d{4}/\d\d/\d\d \d\d:\d\d:\d\d(?:[.,]\d{1,9})?(?: ?(?:Z|[+-]\d\d:?\d\d))?)(?![\d:])"
_SYSLOG = r"(?P<syslog>(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [ \d]\d \d\d:\d\d:\d\d(?:\.\d{1,9})?)(?![\d:])"
_SHORT = r"(?P<short>(?P<letter>[A-Z])\d{4} \d\d:\d\d:\d\d\.\d{1,9})(?![\d:])"
_EPOCH = r"(?P<epoch>\d{9,10}(?:\.\d{1,9})?)(?![\w.:-])"
TOKEN = re.compile(rf"{_ISO}|{_SLASH}|{_SYSLOG}|{_SHORT}|{_EPOCH}|(?P<key>[A-Za-z_]\w*)(?==)|(?P<num>\d+(?!\w))|(?P<word>\w[\w./-]*(?:::[\w./-]+)*)|(?P<space>\s+)|(?P<mark>.)", re.S)
STAMPS = ("iso", "slash", "syslog", "short", "epoch")


def _zone(text: str | None) -> timezone:
    if not text or text.strip() == "Z":
        return timezone.utc
    t = text.strip().replace(":", "")
    return timezone((1 if t[0] == "+" else -1) * timedelta(hours=int(t[1:3]), minutes=int(t[3:5])))


def _fraction(digits: str | None) -> int:
    return int((digits or "").strip(".,")[:6].ljust(6, "0") or 0)


_ISO_PARTS = re.compile(r"(\d{4})[-/](\d\d)[-/](\d\d)[T ](\d\d):(\d\d):(\d\d)([.,]\d+)? ?(Z|[+-]\d\d:?\d\d)?$")
_YEARLESS = re.compile(r"(?:([A-Z][a-z]{2}) ([ \d]\d)|[A-Z]?(\d\d)(\d\d)) (\d\d):(\d\d):(\d\d)(\.\d+)?$")


def stamp_time(text: str, not_after: datetime | None) -> datetime | None:
    """The UTC time (naive) of a stamp's text; None where it is no real time.

    Without zone it is UTC; without year the latest one not after ``not_after`` (None: no time can be told).
    """
    try:
        if m := _ISO_PARTS.match(text):
            y, mo, d, h, mi, s = (int(x) for x in m.groups()[:6])
            t, zone = datetime(y, mo, d, h, mi, s, _fraction(m.group(7))), m.group(8)
            return t if zone is None or zone == "Z" else t.replace(tzinfo=_zone(zone)).astimezone(timezone.utc).replace(tzinfo=None)
        if m := _YEARLESS.match(text):
            if not_after is None:
                return None
            month = MONTHS[m.group(1)] if m.group(1) else int(m.group(3))
            day = int(m.group(2) or m.group(4))
            for year in range(not_after.year, not_after.year - 9, -1):
                try:
                    t = datetime(year, month, day, int(m.group(5)), int(m.group(6)), int(m.group(7)), _fraction(m.group(8)))
                except ValueError:
                    if not (month == 2 and day == 29):
                        return None
                    continue
                if t <= not_after:
                    return t
            return None
        whole, _, frac = text.partition(".")
        return datetime(1970, 1, 1) + timedelta(seconds=int(whole), microseconds=_fraction(frac))
    except (ValueError, OverflowError, KeyError):
        return None


def clean_line(text: str | None) -> str:
    """A line without colour codes and the carriage return at its end; null is empty."""
    return ANSI.sub("", text or "").rstrip("\r")


BRACKETS = {"[": 1, "(": 1, "<": 1, "{": 1, "]": -1, ")": -1, ">": -1, "}": -1}


def _level_word(text: str) -> bool:
    """Whether a word is a level's; a single letter is one only as a capital."""
    return text.lower() in LEVELS and (len(text) > 1 or text.isupper())


def lex(line: str) -> list[tuple[str, str]]:
    """Typed tokens (mask, text) of a line's head; none where no stamp can begin a header.

    A head ends at an opening quote, at a second stamp, at a word behind time, level and component, or, from
    HEAD_TOKENS on, in prose (three words in a row) and where so many tokens bring no bracket and no key.
    """
    out: list[tuple[str, str]] = []
    stamped = words = level = keyed = closed = False
    depth = run = since = 0
    for m in TOKEN.finditer(line):
        kind, text = m.lastgroup, m.group()
        # blanks, words and numbers are most tokens: they change little of the state
        plain = " " if kind == "space" else "<N>" if kind == "num" else "<W>" if kind == "word" and not _level_word(text) else ""
        if plain:
            if plain != "<N>" and not stamped:
                return []
            if plain == "<W>":
                if closed:
                    break
                words, run = True, run + (depth == 0)
            out.append((plain, text))
            since += 1
            if len(out) >= HEAD_TOKENS and (run >= 3 or since >= HEAD_TOKENS):
                break
            continue
        if kind == "iso":
            zone = m.group("zone")
            frac = m.group("frac") or ""
            mask = f"<TIME iso{m.group('sep')}{frac[:1]}{'' if not frac else -(-(len(frac) - 1) // 3)}{'' if not zone else 'Z'}>"
        elif kind == "slash":
            mask = "<TIME slash>"
        elif kind == "syslog":
            mask = "<TIME month>"
        elif kind == "short":
            if m.start():  # only at the very start is the letter a level
                mask, text = "<W>", text
            else:
                out.append(("<LEVEL letter>", m.group("letter")))
                mask, text = "<TIME short>", text[1:]
        elif kind == "epoch":
            mask = "<TIME epoch>" if "." in text else "<N>"
        elif kind == "key":
            mask = f"{text}="
        elif kind == "word":
            mask = "<LEVEL letter>" if len(text) == 1 else "<LEVEL>"
        else:
            mask = text
        if not stamped and mask in ("<W>", '"'):
            return []
        time = _is_time(mask)
        if (stamped and time) or (closed and mask == "<W>"):
            break
        out.append((mask, text))
        if mask == '"':
            break
        if mask == "<W>":
            words, run = True, run + (depth == 0)
        elif _is_level(mask) or kind == "short":
            level, run = True, 0
        elif mask not in (" ", "<N>"):
            run, keyed = 0, keyed or kind == "key"
        if time:
            stamped = True
        if mask not in ("<W>", "<N>") and not _is_level(mask):
            closed = stamped and words and level and not keyed
        since += 1
        if kind == "key" or mask in BRACKETS:
            depth, since = max(0, depth + BRACKETS.get(mask, 0)), 0
        if len(out) >= HEAD_TOKENS and (run >= 3 or since >= HEAD_TOKENS):
            break
    return out if stamped else []


_MEMBER = re.compile(r'\s*[{,]\s*"((?:[^"\\]|\\.)*)"\s*:\s*("(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|\{|\[)')


def lex_object(line: str) -> list[tuple[str, str, str]] | None:
    """Members of a line that is a JSON object, in key order: (key, type of the value, value text).

    A line cut short gives the members before the cut; None where it is no object.
    """
    if not line.startswith("{"):
        return None
    try:
        doc = json.loads(line)
        members = list(doc.items()) if isinstance(doc, dict) else []
    except ValueError:
        members, at = [], 0
        while m := _MEMBER.match(line, at):
            raw = m.group(2)
            if raw in "{[":
                break
            try:
                members.append((json.loads(f'"{m.group(1)}"'), json.loads(raw)))
            except ValueError:
                break
            at = m.end()
    out = []
    for k, v in members:
        if isinstance(v, str):
            m = TOKEN.fullmatch(v)
            if m and m.lastgroup in STAMPS and m.lastgroup != "short":
                kind = "TIME"
            elif v.lower() in LEVELS:
                kind = "LEVEL"
            else:
                kind = "W" if re.fullmatch(r"[\w./:-]+", v) else "TEXT"
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            kind, v = ("TIME" if 1e8 <= v < 1e11 else "N"), repr(v)
        else:
            kind, v = "OTHER", next((x for x in v.values() if isinstance(x, str)), "") if isinstance(v, dict) else json.dumps(v)
        out.append((k if k.isprintable() else json.dumps(k), kind, v))
    return sorted(out) or None


#: What any stamp holds; a line without it has no header and need not be lexed.
STAMPED = re.compile(r"\d\d:\d\d:\d\d|\d{9}")


def sequence(line: str) -> tuple[list[str], list[tuple]]:
    """The line's start and the masks of its head, and the tokens they stand for.

    Of an object the masks are its keys in order, each with its value's type after a separator.
    """
    if not STAMPED.search(line):
        return [], []
    obj = lex_object(line)
    if obj:
        return ["^", "{}", *(f"{k}\x1d{t}" for k, t, _ in obj)], obj
    tokens = lex(line)
    if not tokens:
        return [], []
    return ["^", *(m for m, _ in tokens)], tokens


def _is_time(mask: str) -> bool:
    return mask.startswith("<TIME")


def _is_level(mask: str) -> bool:
    return mask.startswith("<LEVEL")


def _digest(parent: str, tail: str) -> str:
    return hashlib.md5(f"{parent}\x1f{tail}".encode("utf-8", "surrogatepass")).hexdigest()


def _keyed(masks: list[str]) -> bool:
    return any(m[-1:] == "=" and len(m) > 1 for m in masks)


def heads(seq: list[str]) -> Iterator[tuple[str, str, str, bool]]:
    """Candidate templates of a plain head, shortest first: (digest, its parent's, the tail from there, open).

    A head ends after its stamp and after every mark or key that follows, at the latest at an opening
    quote, and before words that no header has (``_grows``). Open: it may grow whatever its share is.
    """
    stamped, words, level, keyed, parent, start = False, False, False, False, "", 1
    for i, m in enumerate(seq[1:], 1):
        if _is_time(m):
            if stamped or any(x in ("<W>", " ") for x in seq[1:i]):  # words before the stamp: no header
                return
            stamped = True
        elif m == '"' and not stamped:
            return
        elif not stamped or m in (" ", "<W>", "<N>") or _is_level(m):
            continue
        tail = seq[start : i + 1]
        key = keyed and tail[-1][-1:] == "="
        if words and level and not key and "<W>" in tail:
            return
        before = next((j for j, x in enumerate(tail) if _is_level(x)), len(tail))
        free = not parent or key or (not level and not _keyed(tail[:before]) and not any(x in ("<W>", "<N>") for x in tail[:before]))
        own = _digest(parent, "\x1f".join(tail))
        yield own, parent, "\x1f".join(tail), free
        if m == '"':
            return
        words, level, keyed = words or "<W>" in tail, level or before < len(tail), keyed or _keyed(tail)
        parent, start = own, i + 1


def is_object(seq: list[str]) -> bool:
    return seq[1:2] == ["{}"]


def object_heads(path: list[str]) -> Iterator[tuple[str, str, str, bool]]:
    """Candidate templates of an object, as of :func:`heads`: its known keys, times first, then the commonest."""
    parent = "{}"
    if path and path[0].endswith("\x1dTIME"):
        for member in path:
            own = _digest(parent, member)
            yield own, parent, member, True
            parent = own


def _grows(tail: list[str], head: list[str], n: int, of: int, lookahead: list[list[str]]) -> bool:
    """Whether a longer head is a header too: most lines have it, or it is a further key, or brings the level.

    A head with time, level and a component takes no further words: they are a message's, however often it comes.
    """
    if tail[-1][-1:] == "=" and any(m[-1:] == "=" and len(m) > 1 for m in head):
        return True
    if "<W>" in tail and "<W>" in head and any(_is_level(m) for m in head):
        return False
    if n >= EXTEND * of:
        return True
    if any(_is_level(m) for m in head):
        return False

    def brings_level(more: list[str]) -> bool:
        level = next((i for i, m in enumerate(more) if _is_level(m)), None)
        return level is not None and not any(m in ("<W>", "<N>") or (m[-1:] == "=" and len(m) > 1) for m in more[:level])

    return brings_level(tail) or any(brings_level(tail + more) for more in lookahead)


#: A longer head or a further key of so few lines of a head is an option of its layout: it changes no field's slot.
REST = 0.02


def choose_templates(support: dict[str, tuple[str, str, int]], least: int) -> dict[str, dict[str, object]]:
    """The plain heads that are headers of programs, with their field roles, from (parent, tail, lines) of each.

    From a layout's bare stamp on, heads grow by what most of its lines have, by keys, and by a level in
    marks. A complete head is a header where ``least`` of its lines go no further. Where these are few (REST), its
    component is a word that is one in the longer head too: what stands before the level may be a thread.
    """
    out: dict[str, dict[str, object]] = {}
    children: dict[str, list[str]] = {}
    for own, (parent, _, _) in support.items():
        children.setdefault(parent, []).append(own)

    def tails(own: str) -> list[list[str]]:
        """What may follow a head up to a level: nothing goes on behind words, numbers or keys."""
        found, todo = [], [(c, []) for c in children.get(own, ())]
        while todo:
            at, before = todo.pop()
            more = before + support[at][1].split("\x1f")
            found.append(more)
            if not any(_is_level(m) or m in ("<W>", "<N>") for m in more) and not _keyed(more):
                todo += [(c, more) for c in children.get(at, ())]
        return found

    frontier = [(own, support[own][1].split("\x1f"), None) for own in children.get("", ())]
    while frontier:
        at, head, kept = frontier.pop()
        of, grown, next_words = support[at][2], 0, {}
        for t in children.get(at, ()):
            tail, n = support[t][1].split("\x1f"), support[t][2]
            if _grows(tail, head, n, of, tails(t)):
                words = [i for i, m in enumerate(head) if m == "<W>"]
                rare = tail[-1][-1:] == "=" and words and n < REST * of
                frontier.append((t, head + tail, words[-1] if rare and kept is None else kept))
                grown += n
                next_words["<W>" in tail] = next_words.get("<W>" in tail, 0) + n
        if of - grown >= least and _complete(head):
            short = of - grown < REST * of and next_words.get(True, 0) > next_words.get(False, 0)
            out[at] = _roles(head) | ({"component": None} if short else {} if kept is None else {"component": kept})
    return out


def _complete(seq: list[str]) -> bool:
    """Whether a head can end here: its brackets are closed; a bare stamp must be written with a zone."""
    pairs = {"[": "]", "(": ")", "<": ">"}
    depth: list[str] = []
    for m in seq:
        if m in pairs:
            depth.append(pairs[m])
        elif depth and m == depth[-1]:
            depth.pop()
    if depth or seq[-1][-1:] == "=" or seq[-1] == "#":
        return False
    return not _is_time(seq[-1]) or (seq[-1].startswith("<TIME iso") and seq[-1].endswith("Z>"))


def _roles(seq: list[str]) -> dict[str, object]:
    """Roles of a head's slots by their types: the stamp, the level, the last word before the message."""
    words = [i for i, m in enumerate(seq) if m == "<W>"]
    return {
        "time": next(i for i, m in enumerate(seq) if _is_time(m)), "level": next((i for i, m in enumerate(seq) if _is_level(m)), None),
        "component": words[-1] if words else None, "length": len(seq),
    }


def object_templates(support: dict[str, tuple[str, str, int]], kinds: dict[str, dict[str, Counter]]) -> dict[str, dict[str, object]]:
    """Roles of the objects' keys by the type most of their values have, from (parent, key, lines) of each head.

    Of two keys of a type the one that its layout always has goes before an optional one: a key of few of the
    shorter head's lines (REST), or of no more than have the shorter head alone.
    """
    out = {}
    alone = Counter({own: n for own, (_, _, n) in support.items()})
    for parent, _, n in support.values():
        alone[parent] -= n
    for own in kinds:
        path, at = [], own
        while at != "{}":
            parent, member, n = support[at]
            path.append((member.split("\x1d")[0], parent != "{}" and n <= max(alone[parent], REST * support[parent][2])))
            at = parent
        path.reverse()
        option = next((i for i, (_, rare) in enumerate(path) if rare), len(path))
        named: dict[str, list[str]] = {}
        component = None
        for part in (path[:option], path[option:]):
            for k in sorted(k for k, _ in part):
                named.setdefault(max(sorted(kinds[own][k]), key=kinds[own][k].get), []).append(k)
            component = component or (named["W"][-1] if "W" in named else None)
        first = {t: ks[0] for t, ks in named.items()}
        out[own] = {"time": first.get("TIME"), "level": first.get("LEVEL"), "component": component, "message": first.get("TEXT") or first.get("OTHER")}
    return out


def _members(seq: list[str]) -> dict[str, str]:
    """An object's members as its heads hold them (times told apart), with the value's type."""
    pairs = [m.split("\x1d") for m in seq[2:]]
    return {f"{k}\x1d{'TIME' if t == 'TIME' else ''}": t for k, t in pairs}


def object_head(seq: list[str], children: dict[str, list[str]]) -> str | None:
    """The longest head of an object among the learned ones, keys it has besides left out."""
    members, at = _members(seq), "{}"
    while (step := next((c for c in children.get(at, ()) if c[0] in members), None)) is not None:
        at = step[1]
    return None if at == "{}" else at


#: The templates with their roles, and the objects' heads: the next members of each, with the longer head's digest.
Learned = tuple[dict[str, dict[str, object]], dict[str, list[tuple[str, str]]]]
#: Head shapes whose template a worker remembers; the memory is dropped when it is full.
KEPT_SHAPES = 100_000


def template_of(seq: list[str], learned: Learned, memory: dict[str, str | None]) -> str | None:
    """The longest template a head has."""
    key = "\x1c".join(seq)
    if key not in memory:
        if len(memory) > KEPT_SHAPES:
            memory.clear()
        if is_object(seq):
            memory[key] = object_head(seq, learned[1])
        else:
            memory[key] = next((t for t, *_ in reversed(list(heads(seq))) if t in learned[0]), None)
    return memory[key]


def read_header(text: str | None, learned: Learned, not_after: datetime | None, memory: dict[str, str | None] | None = None) -> tuple[datetime, str, str, str] | None:
    """(time, level, component, message) of a line that begins with a header; None of any other line."""
    line = clean_line(text)
    seq, tokens = sequence(line)
    t = template_of(seq, learned, {} if memory is None else memory) if seq else None
    if t is None:
        return None
    r = learned[0].get(t)
    if r is None:
        return None
    if is_object(seq):
        value = {k: v for k, _, v in tokens}
        part = {f: value.get(r[f], "") if r[f] else "" for f in ("time", "level", "component", "message")}
    else:
        part = {f: tokens[r[f]][1] if r[f] is not None else "" for f in ("time", "level", "component")}
        part["message"] = line[sum(len(x) for _, x in tokens[: r["length"]]) :].strip()
    at = stamp_time(part["time"], not_after)
    return None if at is None else (at, LEVELS.get(part["level"].lower(), ""), part["component"], part["message"])


# ---------------------------------------------------------------- on Spark


def _shapes(lines: DataFrame) -> DataFrame:
    """The masked heads of all lines with the number of lines that have each: counted per batch, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter = Counter()
            for text in b.column(0).to_pylist():
                seq, _ = sequence(clean_line(text))
                if seq:
                    n["\x1c".join(seq)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["k", "n"])

    return lines.select("text").mapInArrow(run, "k string, n long").groupBy("k").agg(F.sum("n").alias("n"))


def _count(shapes: DataFrame, each, schema: str) -> DataFrame:
    """The rows of strings that ``each`` gives of a head, with the lines that have them: per batch, then summed."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter = Counter()
            for k, lines in zip(b.column(0).to_pylist(), b.column("n").to_pylist()):
                for x in each(k):
                    n[x] += lines
            cols = [pa.array([x[i] for x in n]) if n else pa.array([], pa.bool_() if schema.split(", ")[i].endswith("boolean") else pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n.values(), pa.int64())], names=[*names, "n"])

    return shapes.mapInArrow(run, f"{schema}, n long").groupBy(*names).agg(F.sum("n").alias("n"))


HEAD = "own string, parent string, tail string, free boolean"


def _supported(rows: DataFrame, least: int) -> dict[str, tuple[str, str, int]]:
    return {r["own"]: (r["parent"], r["tail"], r["n"]) for r in rows.where(F.col("n") >= least).select("own", "parent", "tail", "n").toLocalIterator()}


def learn(lines: DataFrame) -> Learned:
    """The headers' templates with their roles, and the objects' heads, from all lines (column text).

    Lines are lexed once, into the counts of their masked heads; all else is counted on those.
    """
    least = MIN_SUPPORT
    shapes = materialize(_shapes(lines), "shapes")
    of_objects = F.col("k").startswith("^\x1c{}\x1c")
    counted = materialize(_count(shapes.where(~of_objects), lambda k: heads(k.split("\x1c")), HEAD).where(F.col("n") >= least), "heads")
    above = counted.select(F.col("own").alias("parent"), F.col("n").alias("of"))
    reached = counted.join(above, "parent", "left").where(F.col("free") | (F.col("n") >= EXTEND * F.col("of")))
    templates = choose_templates(_supported(reached, least), least)

    objects = shapes.where(of_objects)
    members = materialize(objects.mapInArrow(_explode, "k string, n long, member string"), "members")
    known = members.groupBy("member").agg(F.sum("n").alias("of")).where(F.col("of") >= least)
    paths = members.join(known, "member").groupBy("k").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct((~F.col("member").endswith("\x1dTIME")).alias("late"), (-F.col("of")).alias("of"), "member"))).alias("m"))
    paths = paths.select(F.array_join(F.col("m.member"), "\x1c").alias("path"), "n")
    support = _supported(_count(paths, lambda k: object_heads(k.split("\x1c")), HEAD), least)
    order = {r["member"]: r["of"] for r in known.join(paths.sparkSession.createDataFrame([(m,) for m in {t for _, t, _ in support.values()}], "member string"), "member").toLocalIterator()} if support else {}
    children: dict[str, list[tuple[str, str]]] = {}
    for own, (parent, member, _) in support.items():
        children.setdefault(parent, []).append((member, own))
    for of in children.values():
        of.sort(key=lambda c: (not c[0].endswith("\x1dTIME"), -order[c[0]], c[0]))

    def typed(k: str) -> Iterator[tuple[str, str, str]]:
        seq = k.split("\x1c")
        at = object_head(seq, children)
        if at is not None:
            for member, kind in _members(seq).items():
                yield at, member.split("\x1d")[0], kind

    kinds: dict[str, dict[str, Counter]] = {}
    if support:
        path_keys = {}
        for own in support:
            at, keys = own, set()
            while at != "{}":
                keys.add(support[at][1].split("\x1d")[0])
                at = support[at][0]
            path_keys[own] = keys
        rows = _count(objects, lambda k: (x for x in typed(k) if x[1] in path_keys[x[0]]), "own string, key string, kind string")
        for r in rows.toLocalIterator():
            kinds.setdefault(r["own"], {}).setdefault(r["key"], Counter())[r["kind"]] += r["n"]
    for t in (shapes, counted, members):
        release(t)
    return templates | object_templates(support, kinds), children


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each member of each object's head."""
    for b in batches:
        rows = [(k, n, m) for k, n in zip(b.column("k").to_pylist(), b.column("n").to_pylist()) for m in _members(k.split("\x1c"))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["k", "n", "member"])


def split_lines(texts: DataFrame, source: str, text: str, not_after: str) -> DataFrame:
    """Texts that hold several lines, as lines: source, line_no (from 1), text, not_after. Null gives none."""
    return texts.select(F.col(source).alias("source"), F.posexplode(F.split(text, "\r?\n")).alias("pos", "text"), F.col(not_after).alias("not_after")).select(
        "source", (F.col("pos") + 1).cast("int").alias("line_no"), "text", "not_after"
    )


def find_headers(lines: DataFrame, learned: Learned) -> DataFrame:
    """The lines that begin with a header: source, line_no, entry_ts, entry_level, component, message."""
    known = lines.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = known.value
        memory: dict[str, str | None] = {}
        for b in batches:
            pick, out = [], []
            times = b.column("not_after").to_pylist()
            for i, text in enumerate(b.column("text").to_pylist()):
                h = read_header(text, learned, times[i] and times[i].replace(tzinfo=None), memory)
                if h:
                    pick.append(i)
                    out.append(h)
            rows = b.take(pa.array(pick, pa.int64()))
            stamps = pa.array([t.isoformat(" ", "milliseconds") for t, *_ in out], pa.string())
            yield pa.RecordBatch.from_arrays(
                [rows.column("source"), rows.column("line_no"), stamps, *(pa.array([h[i] for h in out], pa.string()) for i in (1, 2, 3))],
                names=["source", "line_no", "entry_ts", "entry_level", "component", "message"],
            )

    return lines.select("source", "line_no", "text", "not_after").mapInArrow(run, "source string, line_no int, entry_ts string, entry_level string, component string, message string")


def _block() -> F.Column:
    return F.floor(F.col("line_no") / BLOCK).alias("block")


def entries(lines: DataFrame) -> DataFrame:
    """One row per entry: source, first_line, last_line, entry_ts, entry_level, component, message.

    ``lines``: source, line_no, text, not_after; repeated (source, line_no) count once, a null text is an
    empty line, null source or line_no are dropped, no lines give no entries. An entry reaches to the line
    before the next entry's or to the source's end. Sources are cut in blocks of lines, so that one file of
    any length is spread over many tasks; only each block's first header is looked at across blocks.
    """
    once = materialize(lines.where("source IS NOT NULL AND line_no IS NOT NULL").groupBy("source", "line_no").agg(F.max("text").alias("text"), F.max("not_after").alias("not_after")), "lines")
    starts = materialize(find_headers(once, learn(once)), "headers").withColumn("block", _block())
    inside = Window.partitionBy("source", "block").orderBy("line_no")
    ends = once.groupBy("source").agg(F.max("line_no").alias("end"))
    firsts = starts.groupBy("source", "block").agg(F.min("line_no").alias("first"))
    across = firsts.select("source", "block", F.lead("first").over(Window.partitionBy("source").orderBy("block")).alias("next_block")).join(ends, "source")
    until = starts.withColumn("next", F.lead("line_no").over(inside)).join(across, ["source", "block"])
    last = F.coalesce(F.col("next") - 1, F.col("next_block") - 1, F.col("end")).cast("int")
    return until.select("source", F.col("line_no").alias("first_line"), last.alias("last_line"), "entry_ts", "entry_level", "component", "message")
