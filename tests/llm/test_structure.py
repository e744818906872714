"""Operators 11 to 13 against brute force and the reference library."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pricewell.llm import pieces, prefix_trie, turn_repair

public_tokenizers = pytest.importorskip("public_tokenizers")
KIND = "conv_id long, turn long, role string, text string, extra string, conv long, h binary, copies int"


def frame(spark, rows):
    """With further columns under names that the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 7, b"y", 9) for r in rows], KIND)


def turn_key(turn):
    return turn is not None, turn or 0


# --- prefix trie -------------------------------------------------------------


def brute_trie(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((turn_key(t), r or "", x or ""))
    seqs = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = [s[1:] for s in sorted(convs.get(c - c % 100, []))[:h]] + [s[1:] for s in sorted(convs[c])[h:]]
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, m in members.items():
        ends = hashlib.sha256(",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(k)).encode()).hexdigest()
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], ends))
    return sorted(out, key=str)


def trie(spark, rows):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(frame(spark, rows)).collect()), key=str)


def random_turns(seed, convs):
    rng = random.Random(seed)
    return [(c, t, rng.choice("uas"), rng.choice(["x", "yy", None, "zzz"])) for c in convs for t in range(rng.randint(1, 8))]


def test_trie_random(spark):
    rows = random_turns(5, range(260))
    rows += [(None, 1, "u", "x"), (3, None, "u", "q"), (3, None, None, None), (-205, 0, "u", "x"), *rows[:30]]  # nulls, ties, repeated rows
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_copies_over_parts(spark):
    same = [(c, t, "u", f"same {t}") for c in range(300) for t in range(7)] + [(c, 0, "u", "same 0") for c in range(1000, 1300)]
    long = [(c, t, "a", f"turn {t}" * (1 + t % 40)) for c in (2000, 2001, 2002) for t in range(900)]
    rows = same + long + [(c, 900, "u", f"end {c}") for c in (2000, 2002)]
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_empty(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 0, "u", "x")]) == []


def test_trie_turnless(spark):
    rows = [(c, 0, "u", "x") for c in range(101, 140)]  # their base is absent, so those that take leads have no turns left
    got = trie(spark, rows)
    assert got == brute_trie(rows) and got[0][1] == 0 and got[0][3] == 39


# --- pieces ------------------------------------------------------------------


def brute_pieces(model, text):
    """Merges the best pair of the whole text, one after the other."""
    own = pieces.Encoder(model)
    symbols = list(own.library.normalize(text))
    while True:
        best = min(((own.cost[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in own.cost), default=None)
        if best is None:
            break
        i = best[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return [i for s in symbols for i in ([own.ids[s]] if s in own.ids else [own.bytes[b] for b in s.encode()])]


def test_pieces(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        model = f.read()
    rng = random.Random(2)
    texts = ["", None, " ", "   a  b ", "▁x ▁", "\x00\x01 \n\n  b", "日本語😀　x y", "<s> <0x41> </s>", "ab" * 300 + " " * 77 + "é"]
    texts += ["".join(rng.choice(" ▁aeiouthns.,\n\té日😀1<>") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "no id", "clash"), (1, "again", "clash"), (1, "again", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = pieces.encode_texts(docs, path).collect()
    assert all(r["agrees"] for r in got) and len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 1)}
    for i, t in enumerate(texts):
        if i != 1:
            assert by_id[i]["ids"] == brute_pieces(model, t or ""), t
            assert by_id[i]["decoded"] == (t or "").replace("▁", " ")
    digests = {r["doc_id"]: r for r in pieces.digests(pieces.encode_texts(docs, path)).collect()}
    assert digests[0]["n_tokens"] == 0 and digests[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    ids = by_id[3]["ids"]
    assert digests[3]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and digests[3]["n_tokens"] == len(ids)


def test_pieces_long_and_empty(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "x" * 200_000), (2, "some words " * 100_000)], "doc_id long, text string")
    assert [r["agrees"] for r in pieces.encode_texts(docs, path).collect()] == [True, True]
    assert pieces.encode_texts(docs.limit(0), path).count() == 0


def vocabulary():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return pieces.Encoder(f.read())


def test_pieces_of_words_that_come_again(monkeypatch):
    """Words met in several batches stay known when others are forgotten, and memory stays bounded."""
    monkeypatch.setattr(pieces, "REMEMBERED", 40)
    own, merged, merge_many = vocabulary(), Counter(), pieces.Encoder.merge_many
    monkeypatch.setattr(own, "merge_many", lambda words: (merged.update(words), merge_many(own, words))[1])
    for k in range(30):
        own.encode_many([f"the river and the stone {' '.join(f'x{k}y{i}' for i in range(8))}", "stone"])
        assert len(own.known) < 40 + 13
    assert [merged["▁" + w] for w in ("the", "river", "and", "stone")] == [1] * 4 and merged["▁x3y5"] == 1


@pytest.mark.parametrize("parted", [True, False])
def test_pieces_equal_the_library(monkeypatch, parted):
    """Borders of texts, words about as long as LONGEST, words forgotten meanwhile, several batches merged at once, texts taken as one word each."""
    monkeypatch.setattr(pieces, "REMEMBERED", 300)
    monkeypatch.setattr(pieces, "MANY", 7)
    own, rng = vocabulary(), random.Random(12)
    own.parted = parted
    fixed = ["", "▁", "▁▁", "a▁", "▁b", " ", "", "é", "\x00", "😀" * 33, "日本語" * 11, *("ab1é"[i % 4] * n for i, n in enumerate(range(28, 37))), *("the" * 12)[:3]]
    for k in range(12):
        texts = fixed[k:] + ["".join(rng.choice(" ▁aeiouthns.,\n\té日😀1<>") for _ in range(rng.randint(0, 60))) for _ in range(40)] + fixed[:k]
        ids, bounds = own.encode_many(texts)
        assert [ids[i:j].tolist() for i, j in itertools.pairwise(bounds)] == own.library.encode(texts), k
    for texts in ([""], ["", ""], ["▁"]):
        ids, bounds = own.encode_many(texts)
        assert [ids[i:j].tolist() for i, j in itertools.pairwise(bounds)] == own.library.encode(texts)


def test_table_of_pairs():
    """Every split of a piece into two symbols is found, other pairs are not."""
    own = vocabulary()
    names = {i: p for p, i in own.ids.items()}
    keys = own.pair_keys[own.pair_keys >= 0]
    at, hit = own._places(keys)
    assert hit.all() and (own.pair_keys[at] == keys).all() and len(set(keys.tolist())) == len(keys)
    for key, makes in zip(keys[:2000].tolist(), own.pair_makes[at[:2000]].tolist(), strict=True):
        x, y = divmod(key, own.span)
        assert x not in names or y not in names or names[x] + names[y] == names[makes]
    assert own._places(keys + 1)[1].sum() == len({*(keys + 1).tolist()} & {*keys.tolist()})
    assert not own._places(keys * 0 - 1)[1].any()


# --- turn repair -------------------------------------------------------------


def cheapest(symbols):
    """(cost, audit) by a search over all edits, the least cost and then the least letters first."""
    heap, seen = [(0, "", 0, 0)], set()
    follow = {0: 2, 1: 2, 2: 3, 3: 2}
    kept = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    while heap:
        c, a, i, s = heapq.heappop(heap)
        if i == len(symbols) and s in (0, 3):
            return c, a
        if (i, s) in seen:
            continue
        seen.add((i, s))
        heapq.heappush(heap, (c + 5, a + "I", i, follow[s]))
        if i < len(symbols):
            heapq.heappush(heap, (c + 2, a + "D", i + 1, s))
            if symbols[i]:
                initial, cut = symbols[i]
                if s in kept.get(initial, {}):
                    heapq.heappush(heap, (c + 5 * cut, a + "K", i + 1, kept[initial][s]))
                heapq.heappush(heap, (c + 1 + 5 * cut, a + "R", i + 1, follow[s]))


def brute_repair(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        r, x, fault = " " if r is None else r, " " if x is None else x, zlib.crc32(key.encode()) % 20
        convs[c] += []
        if fault == 0:
            continue
        x = "" if fault == 1 else re.sub("[.!?]", "", x) if fault == 2 else x
        convs[c] += [(t, "user" if fault == 4 else r, x)] * (2 if fault == 3 else 1)
    out = []
    for c, turns in convs.items():
        turns.sort(key=lambda s: (turn_key(s[0]), s[1], s[2][:32], hashlib.md5(f"{len(s[1])}:{s[1]}{s[2]}".encode()).digest()))
        seen, symbols, counts = set(), [], Counter()
        for _, r, x in turns:
            said = re.sub(r"[\x20\x09-\x0D]+\Z", "", x)
            fault = "blank" if not said else "duplicate" if (r, x) in seen else "truncated" if said[-1] not in ".!?" else None
            seen.add((r, x))
            counts[fault] += 1
            symbols.append(None if fault in ("blank", "duplicate") else (r[:1], fault == "truncated"))
        cost, audit = cheapest(symbols)
        text, i, state = [], 0, 0
        for e in audit:
            if e in "RI":
                state = 3 if state == 2 else 2
                text.append(("user:" if state == 2 else "assistant:") + (turns[i][2] if e == "R" else ""))
            elif e == "K":
                state = {"s": 1, "u": 2, "a": 3}[turns[i][1][0]]
                text.append(f"{turns[i][1]}:{turns[i][2]}")
            i += e != "I"
        known = {t for t, _, _ in turns if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        out.append((c, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()))
    return sorted(out, key=str)


def repaired(spark, rows):
    return sorted((tuple(r) for r in turn_repair.repair_conversations(frame(spark, rows)).collect()), key=str)


def test_tables():
    vectors, table, total = turn_repair.tables()
    assert table.shape == (len(vectors), turn_repair.SYMBOLS**turn_repair.BLOCK)
    for symbols in itertools.chain.from_iterable(itertools.product(range(9), repeat=n) for n in range(3)):
        told = [None if s == 0 else ("sua?"[(s - 1) // 2], (s - 1) % 2) for s in symbols]
        assert turn_repair.repair(bytes(symbols)) == cheapest(told)


def test_repair_random(spark):
    rng = random.Random(11)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "unknown"]
    said = ["Yes.", "No", "", " \t\n", None, "Well!  ", "x" * 40 + "?", "x" * 40 + "!", "a.b"]
    rows = [(c, t, rng.choice(roles), rng.choice(said)) for c in range(300) for t in range(0, rng.randint(1, 40), rng.randint(1, 2))]
    rows += [(None, 1, "user", "x."), (None, None, "assistant", "y."), (7, None, "user", "a."), (7, None, "user", "b."), *rows[:40]]
    assert repaired(spark, rows) == brute_repair(rows)


def test_repair_empty_and_dropped(spark):
    assert repaired(spark, []) == []
    gone = next((c, t) for c in range(100) for t in range(100) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    assert repaired(spark, [(*gone, "user", "Hello.")]) == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repair_one_long_conversation(spark):
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant", "tool"]), f"Line {t % 2000}" + rng.choice([".", "", "!"])) for t in range(20_000)]
    rows += [(1, t, "user", "Long " * 10_000 + ".") for t in (20_001, 20_002)]
    assert repaired(spark, rows) == brute_repair(rows)
