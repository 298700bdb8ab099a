"""Line dedup against a direct comparison of all windows."""

import random

import pytest

from stratasearch.llm import line_dedup

LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(line):
    for c in "\t\n\x0b\x0c\r":
        line = line.replace(c, " ")
    return tuple(w.translate(LOWER) for w in line.split(" ") if w)


def brute_force(documents, least_words):
    """Deleted lines of each document."""
    seen, out = set(), {}
    for doc, text in sorted((d for d in documents if d[1] is not None), key=lambda d: d[0]):
        lines = [words_of(x) for x in text.split("\n")]
        windows = []
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                size = sum(map(len, lines[i : j + 1]))
                shortest = size - len(lines[j]) < least_words or size - len(lines[i]) < least_words
                if lines[i] and lines[j] and size >= least_words and shortest:
                    windows.append((i, j, tuple(lines[i : j + 1])))
        for i, j, run in sorted(windows):
            if run in seen:
                out.setdefault(doc, set()).update(range(i, j + 1))
            seen.add(run)
    return out


def maximal_runs(documents, least_words):
    """Deleted lines by the definition itself: every run with enough words that came before."""
    out, before = {}, []
    for doc, text in sorted(documents):
        lines = [words_of(x) for x in text.split("\n")]
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if sum(map(len, lines[i : j + 1])) < least_words:
                    continue
                run = lines[i : j + 1]
                earlier = any(other[k : k + len(run)] == run for other in before for k in range(len(other)))
                earlier = earlier or any(lines[k : k + len(run)] == run for k in range(i))
                if earlier:
                    out.setdefault(doc, set()).update(range(i, j + 1))
        before.append(lines)
    return out


def spans_of(frame):
    return {
        r["doc_id"]: {k for s in r["spans"] for k in range(s["first"], s["last"] + 1)} for r in frame.collect()
    }


def random_documents(seed, n=40):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(12)] + [""]
    return [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 10)))) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_windows(spark, seed):
    rows = random_documents(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert spans_of(line_dedup.repeated_runs(frame, 8)) == brute_force(rows, 8)


def test_windows_cover_whole_runs():
    """No blank lines at a run's ends: then windows delete what the definition deletes."""
    rng = random.Random(5)
    pool = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(6)]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 8)))) for k in range(30)]
    assert brute_force(rows, 7) == maximal_runs(rows, 7)


def test_whole_table(spark, data):
    frame = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in frame.collect()]
    want = brute_force(rows, 50)
    got = line_dedup.drop_repeated_runs(frame).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["removed_lines"] for r in got if r["removed_lines"]} == {
        d: len(x) for d, x in want.items()
    }
    texts = dict(rows)
    for r in got:
        lines = texts[r["doc_id"]].split("\n")
        gone = want.get(r["doc_id"], set())
        assert r["text"] == "\n".join(x for k, x in enumerate(lines) if k not in gone)


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, None, 7), (2, "", 7), (3, long, 7), (4, f"x\n{long.upper()}\ny", 7), (None, long, 7), (5, f"{long}\n{long}", 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in line_dedup.drop_repeated_runs(frame).collect()}
    assert got == {1: (None, 0), 2: ("", 0), 3: (long, 0), 4: ("x\ny", 1), None: (long, 0), 5: ("", 2)}
    assert line_dedup.drop_repeated_runs(frame.limit(0)).count() == 0


def test_columns_stay(spark):
    long = " ".join(f"w{k}" for k in range(60))
    frame = spark.createDataFrame([(1, long, 5, [1], 8), (2, long, 6, [2], 9)], "doc_id int, text string, cut int, spans array<int>, removed_lines int")
    got = line_dedup.drop_repeated_runs(frame)
    assert got.columns == [*frame.columns, "removed_lines_1"]
    assert sorted(map(tuple, got.collect())) == [(1, long, 5, [1], 8, 0), (2, "", 6, [2], 9, 1)]


def test_positions_are_sparse():
    """Winnowing selects a part of the lines only, and each window of a text holds one of them."""
    rng = random.Random(9)
    text = "\n".join(" ".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(1000)).encode()
    units, owner, _ = line_dedup.text_lines([text])
    first, last, least = line_dedup.windows(units, owner, 50)
    assert len(first) > 900 and len(set(least.tolist())) < 300
    assert ((least >= first) & (least <= last)).all()


def test_a_line_that_is_everywhere(spark):
    """The first occurrence of a common line explains little; its other contexts are found all the same."""
    rng = random.Random(12)
    common = "the one line that all texts share"
    blocks = [[" ".join(rng.choice("abcdefgh") * 2 for _ in range(4)) for _ in range(3)] for _ in range(6)]
    rows = []
    for k in range(60):
        before, after = rng.choice(blocks), rng.choice(blocks)
        rows.append((k, "\n".join([f"own {k}", *before[: rng.randint(1, 3)], common, "", *after[: rng.randint(1, 3)], common])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert spans_of(line_dedup.repeated_runs(frame, 12)) == brute_force(rows, 12)


def test_lists_beyond_the_bounds_are_shuffled(spark, monkeypatch):
    """Rows and bytes are both bounded; beyond either the join shuffles, with the same result."""
    rng = random.Random(21)
    rows = [(k, "\n".join(rng.choice("abc") * 3 + " " + rng.choice("de") for _ in range(30))) for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, line_dedup.drop_repeated_runs(frame, 8).collect()))
    assert any(row[2] for row in want)
    for bound in ("MOST_SPANS", "MOST_CONTEXT", "MOST_BROADCAST"):
        with monkeypatch.context() as patch:
            patch.setattr(line_dedup, bound, 1)
            result = line_dedup.drop_repeated_runs(frame, 8)
            assert bound == "MOST_CONTEXT" or "rightHint=(strategy=broadcast)" not in result._jdf.queryExecution().toString()
            assert sorted(map(tuple, result.collect())) == want
