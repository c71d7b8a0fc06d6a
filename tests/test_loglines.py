from datetime import datetime as dt

from lodestrata.operators import loglines as L

#: Layouts of invented programs: (line, time, level, component).
AT = dt(2025, 3, 1)


def layouts(i):
    s, ms = i % 60, (i * 37) % 1000
    return [
        (f"17400000{s:02d}.{ms:03d} I sweeper | did {i} things: all of them", dt(2025, 2, 19, 21, 20, s, ms * 1000), "INFO", "sweeper"),
        (f"Feb  3 10:00:{s:02d} host-{i % 7} prog-one[{i}]: <warning> low [disk_{i}] space", dt(2025, 2, 3, 10, 0, s), "WARN", "prog-one"),
        (f"Feb  3 10:00:{s:02d} host-{i % 7} prog-one[{i}]: nothing of note {i}", dt(2025, 2, 3, 10, 0, s), "", "prog-one"),
        (f"2025-02-03T11:00:{s:02d}.{ms:03d}000Z  WARN a::b{i % 3}: level ERROR was expected", dt(2025, 2, 3, 11, 0, s, ms * 1000), "WARN", f"a::b{i % 3}"),
        (f"2025-02-03T11:00:{s:02d}.{ms:03d}0000Z ##[error]it broke {i}", dt(2025, 2, 3, 11, 0, s, ms * 1000), "ERROR", ""),
        (f"2025-02-03T11:00:{s:02d}.{ms:03d}0000Z plain text {i}", dt(2025, 2, 3, 11, 0, s, ms * 1000), "", ""),
        (f"2025-02-03 11:00:{s:02d},{ms:03d} [worker-{i % 5}] CRITICAL store.walker - gone {i}", dt(2025, 2, 3, 11, 0, s, ms * 1000), "ERROR", "store.walker"),
        (f"E1231 23:59:{s:02d}.{ms:03d}000  {i} docs.rs:{i}] rewrites {i}", dt(2024, 12, 31, 23, 59, s, ms * 1000), "ERROR", "docs.rs"),
        (f"[2025/02/03 13:00:{s:02d} +0200] [debug] (impact) reading {i}", dt(2025, 2, 3, 11, 0, s), "DEBUG", "impact"),
        (f'ts=2025-02-03T11:00:{s:02d}Z level=error component=scan msg="a=b {i}"', dt(2025, 2, 3, 11, 0, s), "ERROR", "scan"),
        (f'{{"timestamp":"2025-02-03T13:00:{s:02d}.{ms:03d}+02:00","level":"info","target":"x.y","fields":{{"message":"done {i}"}}}}', dt(2025, 2, 3, 11, 0, s, ms * 1000), "INFO", "x.y"),
        (f'{{"msg": "went on {i}", "lvl": "fatal", "ts": 17400000{s:02d}.{ms:03d}, "logger": "query"}}', dt(2025, 2, 19, 21, 20, s, ms * 1000), "ERROR", "query"),
    ]


OTHER = ["Traceback (most recent call last):", '  File "x.py", line 3, in f', "    2025-02-03 11:00:01,123 [worker-1] INFO store.walker - quoted", "at 2025-02-03 10:00:00 it stopped", "{", '  "limit": 3', "}", None, "", "note: run with more"]


def lines_of(n=40):
    rows, want, no = [], [], 0
    for i in range(n):
        for line, at, level, component in layouts(i):
            no += 1
            rows.append(("log", no, ("\x1b[2m" + line[:10] + "\x1b[0m" + line[10:] if i % 9 == 0 and line[:4] == "2025" else line) + ("\r" if i % 4 == 0 else ""), AT))
            want.append([no, None, at, level, component])
        if i % 3 == 0:
            for x in OTHER:
                no += 1
                rows.append(("log", no, x, AT))
    for a, b in zip(want, want[1:]):
        a[1] = b[0] - 1
    want[-1][1] = no
    return rows, want


def run(spark, rows):
    return L.entries(spark.createDataFrame(rows, "source string, line_no int, text string, not_after timestamp"))


def test_entries_of_every_layout(spark):
    rows, want = lines_of()
    got = sorted((r["first_line"], r["last_line"], r["entry_ts"], r["entry_level"], r["component"]) for r in run(spark, rows + rows[:50]).collect())
    assert got == sorted((a, b, f"{t:%Y-%m-%d %H:%M:%S}.{t.microsecond // 1000:03d}", lv, c) for a, b, t, lv, c in want)


def test_blocks_of_a_long_file_join(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 7)
    rows, want = lines_of(12)
    got = sorted((r["first_line"], r["last_line"]) for r in run(spark, rows).collect())
    assert got == sorted((a, b) for a, b, *_ in want)


def test_nothing_and_prose(spark):
    assert run(spark, []).count() == 0
    assert run(spark, [("s", 1, "only prose here", AT), ("s", 2, None, None), (None, 3, "x", AT)]).count() == 0


def test_times_without_year_or_zone():
    assert L.stamp_time("Feb 29 01:02:03", dt(2025, 3, 1)) == dt(2024, 2, 29, 1, 2, 3)
    assert L.stamp_time("0301 00:00:00.5", dt(2025, 3, 1)) == dt(2025, 3, 1) or L.stamp_time("0301 00:00:00.5", dt(2025, 3, 1)) == dt(2024, 3, 1, 0, 0, 0, 500000)
    assert L.stamp_time("2025-13-01 00:00:00", None) is None and L.stamp_time("Feb 30 00:00:00", dt(2025, 3, 1)) is None
    assert L.stamp_time("2025-01-01T00:30:00.1239999-05:30", None) == dt(2025, 1, 1, 6, 0, 0, 123999)


def test_split_lines(spark):
    t = spark.createDataFrame([("a", "x\r\ny\nz", AT), ("b", None, AT), ("c", "", AT)], "source string, t string, at timestamp")
    assert sorted((r["source"], r["line_no"], r["text"]) for r in L.split_lines(t, "source", "t", "at").collect()) == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("c", 1, "")]


def test_a_rare_program_is_found_among_many_lines(spark):
    many = spark.range(45_000).selectExpr("'big' AS source", "CAST(id + 1 AS INT) AS line_no", "concat('2025-02-03T11:00:00.123456Z  WARN a::b: went on ', id) AS text", "timestamp'2025-03-01' AS not_after")
    object_line = '{"timestamp":"2025-02-03T11:00:00Z","level":"info","target":"x.y",%s"fields":{"message":"done"}}'
    few = [f"2025-02-03 11:00:0{i},123 [worker-{i}] ERROR store.walker - gone" for i in range(5)]
    few += [object_line % ""] * 20 + [object_line % '"zone":"eu",'] * 5 + [object_line % f'"only{i}":"once",' for i in range(3)]
    rare = spark.createDataFrame([("rare", i + 1, x, AT) for i, x in enumerate(few)], "source string, line_no int, text string, not_after timestamp")
    got = L.entries(many.unionByName(rare)).where("source = 'rare'").orderBy("first_line").collect()
    assert [(r["first_line"], r["last_line"]) for r in got] == [(i, i) for i in range(1, 34)]
    assert [(r["entry_level"], r["component"]) for r in got] == [("ERROR", "store.walker")] * 5 + [("INFO", "x.y")] * 28


def test_a_line_with_a_brace_that_is_no_object(spark):
    assert run(spark, [("s", i, "{ 10:00:00 }", AT) for i in range(1, 6)]).count() == 0


def test_few_lines_that_stop_at_a_shorter_header(spark):
    lines = [f"Feb  3 10:00:{i % 60:02d} host-1 prog-one[{i}]: " + ("nothing of note" if i % 100 == 7 else "<warning> low space") for i in range(500)]
    got = run(spark, [("s", i + 1, x, AT) for i, x in enumerate(lines)]).orderBy("first_line").collect()
    assert [(r["first_line"], r["entry_level"], r["component"]) for r in got] == [(i + 1, "" if i % 100 == 7 else "WARN", "prog-one") for i in range(500)]


def test_wide_objects_and_headers(spark):
    members = ",".join(f'"a{k:02d}":{k}' for k in range(25))
    lines = [f'{{{members},"level":"error","target":"x.y","time":"2025-02-03T11:00:0{i}Z","what":"it broke"}}' for i in range(5)]
    lines += [f"2025-02-03 11:00:0{i},123 [pool-{i}] [a:{i}] [b:{i}] [c:{i}] [d:{i}] [e:{i}] [f:{i}] ERROR store.walker - gone" for i in range(5)]
    got = run(spark, [("s", i + 1, x, AT) for i, x in enumerate(lines)]).orderBy("first_line").collect()
    assert [(r["first_line"], r["entry_level"], r["component"]) for r in got] == [(i, "ERROR", "x.y" if i < 6 else "store.walker") for i in range(1, 11)]
