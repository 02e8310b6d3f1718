"""Repeated runs of lines to their last line."""

import random

from comparing import SMALL

from sparsewell.llm import linededup


def words(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n))


def brute_runs(rows, least):
    """Texts without the lines of any run of ``least`` words that stood before, by comparing
    every pair of places."""
    texts = [(d, t.split("\n"), [i for i, x in enumerate(t.split("\n")) if x.split()]) for d, t in sorted(rows)]
    out = {}
    for x, (d, lines, units) in enumerate(texts):
        gone = set()
        for y, (_, lines0, units0) in enumerate(texts[: x + 1]):
            for a in range(len(units)):
                for a0 in range(len(units0) if y < x else a):
                    n = 0
                    while a + n < len(units) and a0 + n < len(units0) and lines[units[a + n]] == lines0[units0[a0 + n]]:
                        n += 1
                    if sum(len(lines[i].split()) for i in units[a : a + n]) >= least:
                        gone.update(range(units[a], units[a + n - 1] + 1))
        out[d] = "\n".join(s for i, s in enumerate(lines) if i not in gone)
    return out


def kept(spark, rows):
    return {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_a_run_is_deleted_to_its_last_line(spark):
    long, short = words("l", 60), words("s", 5)
    rows = [(1, f"{long}\n{short}\n{words('a', 20)}"), (2, f"{words('b', 9)}\n{long}\n\n{short}\n{words('c', 20)}")]
    assert kept(spark, rows)[2] == f"{words('b', 9)}\n{words('c', 20)}"


def test_a_run_ends_where_the_longest_place_before_does(spark):
    long, short = words("l", 60), words("s", 5)
    rows = [(1, f"{long}\n{words('a', 20)}"), (2, f"{long}\n{short}\n{words('b', 20)}"), (3, f"{long}\n{short}\n{words('c', 20)}")]
    assert kept(spark, rows) == {1: rows[0][1], 2: f"{short}\n{words('b', 20)}", 3: words("c", 20)}


def test_whole_runs_by_brute_force(spark):
    rng = random.Random(10)
    stock = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice((0, 1, 5, 20, 30, 60)))) for _ in range(25)]
    rows = [(i, "\n".join(stock[(k + i * 7) % 25] if rng.random() < 0.9 else "other" for k in range(rng.randrange(0, 14)))) for i in range(60)]
    want = brute_runs(rows, linededup.MIN_WORDS)
    assert kept(spark, rows) == want


def test_whole_runs_of_a_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    some = docs.where("doc_id % 3 = 0").select("doc_id", "text").collect()
    want = brute_runs([(r.doc_id, r.text or "") for r in some], linededup.MIN_WORDS)
    assert {r.doc_id: r.text for r in linededup.dedup_lines(docs.where("doc_id % 3 = 0")).collect()} == want


def test_no_line_of_a_run_is_left(spark):
    """Ends of runs that make fewer words than a window, at both ends and between."""
    a, b, c, d = (words(x, n) for x, n in zip("abcd", (50, 5, 60, 60), strict=True))
    assert kept(spark, [(1, f"{a}\n{b}\n{c}"), (2, f"{a}\n{b}\n{d}")])[2] == d
    e, f, g = words("e", 40), words("f", 20), words("g", 9)
    assert kept(spark, [(1, f"{e}\n{f}\n{g}"), (2, f"x\n{e}\n{f}\n{g}\ny")])[2] == "x\ny"
    assert kept(spark, [(1, f"{g}\n{f}\n{e}"), (2, f"x\n\n{g}\n \n{f}\n{e}\n\ny")])[2] == "x\n\n\ny"


def test_odd_blanks_count_no_words(spark):
    line = "\t" + "  ".join(f"w{i}" for i in range(49)) + " \x0b\r"
    rows = [(1, f"{line}\na"), (2, f"{line}\nb"), (3, f"{line}\nlast one\na"), (4, f"{line}\nlast one")]
    assert kept(spark, rows) == {1: rows[0][1], 2: rows[1][1], 3: rows[2][1], 4: ""}


def test_texts_of_ten_thousand_lines(spark):
    text = "\n".join(words(f"t{i}", 3) for i in range(10_000))
    assert kept(spark, [(1, text), (2, "own line\n" + text)]) == {1: text, 2: "own line"}


def test_null_and_equal_rows(spark):
    text = words("z", 60)
    got = linededup.dedup_lines(spark.createDataFrame([(None, text), (5, text), (5, text), (6, None)], "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in got) == [(0, text), (5, ""), (5, ""), (6, "")]
