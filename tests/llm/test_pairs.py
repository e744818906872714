"""Brute-force comparisons of the n-gram join, the decontamination and line dedup."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pricewell.llm import decontaminate, line_dedup, ngram_join
from pricewell.llm.common import LOWER, UPPER
from pricewell.llm.components import connected_components
from pricewell.llm.text_hash import shingle_sets, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall((text or "").translate(str.maketrans(UPPER, LOWER)))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(id, size, smallest id reachable) by all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and sets[a][0] is not None and sets[b][0] is not None and 100 * len(x & y) >= 80 * len(x | y):
                root[top(a)] = top(b)
    out = []
    for k, (i, s) in enumerate(sets):
        out.append((i, len(s), min(sets[j][0] for j in range(len(sets)) if top(j) == top(k) and sets[j][0] is not None) if s and i is not None else i))
    return sorted(out, key=str)


def corpus(seed=1, groups=14, hot=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 40, 120, 300]))]
        for _ in range(hot if g == 0 else rng.randint(1, 5)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 60))):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            rows.append((i, " ".join(text)))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"max_list": 4, "unit_docs": 4, "unit_tokens": 2000, "hot": 8.0}])
def test_components_equal_brute_force(spark, options):
    rows = corpus(groups=14)
    rows += [(900, ""), (901, None), (902, "one"), (903, "ONE"), (904, "  \t\n"), (905, rows[0][1]), (905, rows[0][1]), (906, "Ä b c d e"), (907, "ä b c d e")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, n long")
    got = [tuple(r) for r in ngram_join.similar_components(df, **options).collect()]
    assert sorted(got, key=str) == brute(rows)


def kept_rows(monkeypatch):
    """Rows of the tables that the join keeps, by name."""
    rows, keep = {}, ngram_join.keep

    def counted(df, name):
        out = keep(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "keep", counted)
    return rows


def test_copies_do_not_pass_for_frequent(spark, monkeypatch):
    """Every text five times, 40 of 100 with one passage: its shingles stay out of the prefixes, as without copies."""
    rng, kept = random.Random(3), kept_rows(monkeypatch)
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join([f"w{rng.randrange(10**9)}" for _ in range(80)] + (passage if i < 40 else [])) for i in range(100)]
    df = spark.createDataFrame([(100 * k + i, t) for k in range(5) for i, t in enumerate(texts)], "doc_id long, text string")
    got = ngram_join.similar_components(df).collect()
    assert kept["postings"] == 0
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(i, i % 100) for i in range(500)]


def test_sketch_stays_sparse(spark, monkeypatch):
    """Of too many frequent shingles the most frequent are in the sketch, whose slots stay a quarter full at most."""
    monkeypatch.setattr(ngram_join, "MOST_FREQUENT", 1 << 14)
    scan = spark.range(100_000).selectExpr("(id * 2654435761) & 4294967295 AS slot", "if(id < 12000, 640L, 3L) AS times").union(spark.createDataFrame([(-1, 0)], "slot long, times long"))
    levels = ngram_join._estimates(scan)
    assert len(levels) == 1 << 16 and 0 < (levels > 0).sum() <= 12_000
    tokens = np.array([i * 2654435761 % 2**32 | 1 << 40 for i in (0, 5, 11_999)], np.uint64)
    assert (ngram_join._frequency(levels, tokens) >= 580).all()


def test_units_meet_in_cells(spark, monkeypatch):
    """Units of a long list are sent to cells, however many partners they have there; no link is lost."""
    monkeypatch.setattr(ngram_join, "CELL", 2)
    kept, words = kept_rows(monkeypatch), [f"w{i}" for i in range(700)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 100])) for i in range(60)]  # each links with its neighbours only
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in ngram_join.similar_components(df, max_list=1, unit_docs=2, unit_tokens=2000).collect()]
    assert sorted(got, key=str) == brute(rows) and kept["unit-links"] > 0


def test_empty_table_and_null_ids(spark):
    assert ngram_join.similar_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    text = " ".join(f"v{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (5, text), (None, "alone but long enough to have shingles"), (7, "")], "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.similar_components(df).collect()), key=str)
    assert got == sorted([(None, 26, 5), (5, 26, 5), (None, 3, None), (7, 0, 7)], key=str)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r[0]: r[1] for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_hashes_do_not_depend_on_slices():
    texts = ["a b c", None, "", "A  B\tc", "x" * 700_000 + " tail", " ".join(f"k{i}" for i in range(200_000))]
    whole = {r: list(s) for r, s in shingle_sets(pa.array(texts))}
    assert whole[0] == whole[3] and whole[1] == whole[2] == []
    for k, t in enumerate(texts):
        assert list(next(iter(shingle_sets(pa.array([t]))))[1]) == whole[k]
    counts = {}
    for row, _, bounds in word_hashes(pa.array(texts)):
        counts |= {row + i: int(bounds[i + 1] - bounds[i]) for i in range(len(bounds) - 1)}
    assert counts == {k: len(WORD.findall(t or "")) for k, t in enumerate(texts)}


def leaks(docs, items, min_words=12):
    """Every shift of every item over every text; the best stretch by +1 / -4."""
    out = {}
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for k, it in items:
            v = WORD.findall((it or "").lower())
            if len(v) < 5:
                continue
            for shift in range(-len(v) + 1, len(w)):
                run = best = hit = total = 0
                for q in range(len(v)):
                    if 0 <= shift + q < len(w):
                        same = w[shift + q] == v[q]
                        run, hit = run + (1 if same else -4), hit + same
                        if run < 0:
                            run = hit = 0
                        if run > best:
                            best, total = run, hit
                if total >= min(min_words, len(v)):
                    out[d, k] = max(out.get((d, k), 0), total)
    return out


@pytest.mark.parametrize("block_words", [400_000, 30])
def test_leaks_equal_brute_force(spark, block_words):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate([20, 30, 5, 7, 12, 40])] + [(90, None), (91, ""), (92, "two words")]
    docs = []
    for d in range(40):
        text = [rng.choice(vocab) for _ in range(rng.randint(5, 80))]
        if d % 2:
            piece = items[d % 6][1].split()
            if d % 4 == 3 and len(piece) > 15:
                piece[len(piece) // 2] = "changed"
            text[3:3] = piece
        docs.append((d, " ".join(text)))
    docs += [(70, None), (71, ""), (72, items[0][1].upper())]
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["matching_words"] for r in decontaminate.find_leaks(df, bench, block_words=block_words).collect()}
    assert got == leaks(docs, items)
    clean = {r["doc_id"] for r in decontaminate.drop_leaks(df, bench, block_words=block_words).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0
    assert decontaminate.drop_leaks(df.limit(0), bench).columns == df.columns


def test_line_templates(spark):
    shared = "this boilerplate line stands in all of them"
    rows = [(d, f"{chr(97 + d) * 3} {chr(98 + d) * 4} own line of a document\n{shared}\nerror 500 at host node{d} port {d}\nuser alice logged in from {'abcdefgh'[d]}x today ok\n\nok") for d in range(8)]
    rows += [(50, None), (51, ""), (52, "nothing shared in here at all")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_lines int")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df, min_docs=5).collect()}
    assert all(shared not in got[d]["text"] and "error" not in got[d]["text"] and "alice" not in got[d]["text"] for d in range(8))
    assert got[0]["n_lines"] == 6 and got[0]["text"].endswith("\n\nok")
    assert got[50]["text"] is None and got[50]["n_lines"] == 0 and got[51]["text"] == "" and got[51]["n_lines"] == 1
    assert got[52]["text"] == "nothing shared in here at all" and got[52]["n_dropped"] == 0
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_exact_lines_equal_brute_force(spark):
    rng = random.Random(9)
    pool = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(rng.randint(3, 9))) for _ in range(60)]
    rows = [(d, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for d in range(60)]
    docs_of = {}
    for d, t in rows:
        for line in t.split("\n"):
            docs_of.setdefault(line, set()).add(d)
    gone = {k for k, v in docs_of.items() if len(k.split()) >= 5 and len(v) >= 5}
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=5).collect()}
    assert got == {d: "\n".join(x for x in t.split("\n") if x not in gone) for d, t in rows}


def test_short_and_long_lines(spark):
    passage = " ".join(f"word{i % 7} and" for i in range(30))
    numbers = lambda d: " ".join(str(100 * d + i) for i in range(60))
    rows = [(d, f"All rights reserved.\npage {d}\n\n{'x' * d} own" + (f"\n{passage}\n{numbers(d)}" if d in (2, 3) else "")) for d in range(1, 6)]
    rows += [(None, f"{passage}\nrare line"), (9, "rare line")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df, min_docs=5, short_docs=5).collect()}
    want = {d: t.replace("All rights reserved.\n", "") for d, t in rows}
    want[3] = want[3].replace(f"{passage}\n", "")
    want[None] = "rare line"
    assert got == want
