"""Every operator against a plain version of it, on small tables."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from data import prints_apart, prose
from docgraph.llm import decontamination, line_dedup, lm_scoring, mixing, quality, records, sharding, simhash, warc


def docs(spark, texts, source="src0"):
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}" if source is None else source, len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_sharding_places_every_key_as_a_walk_of_the_ring_does(spark):
    got = {r.doc_id: r.shard for r in sharding.assign_shards(docs(spark, ["x"] * 500), 7, 16, 0.05).collect()}
    at, owner = sharding.ring(7, 16)
    bound, load = math.ceil(1.05 * 500 / 7), Counter(got.values())
    assert sum(load.values()) == 500 and max(load.values()) <= bound
    hashed = spark.range(500).selectExpr("id", "xxhash64(cast(id as string)) as h").collect()
    first = {r.id: int(owner[np.searchsorted(at, r.h) % len(at)]) for r in hashed}
    moved = [k for k in got if got[k] != first[k]]
    full = {s for s in range(7) if load[s] == bound}
    assert all(first[k] in full for k in moved)  # only a full shard lets go of its own keys
    assert {k for k in got if got[k] == first[k]} >= {k for k in got if first[k] not in full}


@pytest.mark.parametrize("keys, shards, vnodes, slack", [(500, 7, 16, 0.05), (3000, 5, 4, 0.0), (40, 9, 3, 0.5)])
def test_sharding_is_a_plain_clockwise_walk(spark, keys, shards, vnodes, slack):
    """Own keys first, then, step by step, what is left of each arc tries the next place; keys of an arc in order of hash and key."""
    at, owner = sharding.ring(shards, vnodes)
    hashed = sorted((r.h, str(r.id)) for r in spark.range(keys).selectExpr("id", "xxhash64(cast(id as string)) as h").collect())
    arcs = {}
    for h, k in hashed:
        arcs.setdefault(int(np.searchsorted(at, h)), []).append(k)
    room, want = [math.ceil((1 + slack) * keys / shards)] * shards, {}
    for step in range(len(at)):
        for arc in sorted(arcs):
            s = int(owner[(arc + step) % len(at)])
            while arcs[arc] and room[s]:
                want[int(arcs[arc].pop(0))] = s
                room[s] -= 1
    got = {r.doc_id: r.shard for r in sharding.assign_shards(docs(spark, ["x"] * keys), shards, vnodes, slack).collect()}
    assert got == want


def test_sharding_moves_few_keys_when_a_shard_is_added(spark):
    d = docs(spark, ["x"] * 2000)
    a, b = ({r.doc_id: r.shard for r in sharding.assign_shards(d, n, 64, 0.25).collect()} for n in (10, 11))
    assert sum(a[k] != b[k] for k in a) < 0.3 * 2000


def test_decontamination_finds_what_word_windows_find(spark):
    rng = random.Random(3)
    items = [prose(1000 + i, rng.choice([4, 9, 20])) for i in range(20)]
    texts = [prose(i, 40) for i in range(60)]
    for i in range(0, 60, 3):
        w = items[i % 20].split()
        k = rng.randrange(max(1, len(w) - 7))
        texts[i] += " -- " + ", ".join(w[k:k + rng.choice([6, 8, 12])]).upper() + "! " + prose(i + 500, 5)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = decontamination.find_leaks(docs(spark, texts), bench).collect()
    want = set()
    plain = lambda t: decontamination.normal(t).split()
    for d, t in enumerate(texts):
        own = plain(t)
        for i, item in enumerate(items):
            w = plain(item)
            n = min(8, len(w))
            windows = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)}
            if any(tuple(own[j:j + n]) in windows for j in range(len(own) - n + 1)):
                want.add((d, i))
    assert {(r.doc_id, r.item_id) for r in got} == want and want
    for r in got:  # offsets are of the original text
        assert " ".join(plain(texts[r.doc_id][r.start_at:r.end_at])) in " ".join(plain(items[r.item_id]))


def test_short_answers_count_with_their_question(spark):
    question = prose(5000, 12)
    bench = spark.createDataFrame([(1, question), (1, "Ulan Bator"), (2, "Timbuktu")], "item_id bigint, text string")
    texts = [question + " so ulan, bator it is", "the answer is Ulan Bator today", "on to timbuktu!", "timbuktus"]
    got = decontamination.find_leaks(docs(spark, texts), bench).collect()
    assert sorted((r.doc_id, r.item_id, texts[r.doc_id][r.start_at:r.end_at]) for r in got) == [(0, 1, question), (0, 1, "ulan, bator"), (2, 2, "timbuktu")]
    assert {r.doc_id for r in decontamination.decontaminate(docs(spark, texts), bench).collect()} == {1, 3}


def test_decontamination_names_the_items_it_was_given(spark):
    text = prose(77, 30)
    for item in (5, 99):
        bench = spark.createDataFrame([(item, text)], "item_id bigint, text string")
        assert [r.item_id for r in decontamination.find_leaks(docs(spark, [text]), bench).collect()] == [item]


def test_a_benchmark_over_many_automata_is_found_whole(spark):
    items = [prose(1000 + i, 20) for i in range(12)]
    texts = [prose(i, 30) + " " + items[i % 12] + " " + items[(i + 5) % 12] for i in range(0, 24, 2)] + [prose(i, 30) for i in range(5)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    a, b = (sorted(map(tuple, decontamination.find_leaks(docs(spark, texts), bench, most_words=n).collect())) for n in (60, 10**6))
    assert a == b and a
    assert {r.doc_id for r in decontamination.decontaminate(docs(spark, texts), bench, most_words=60).collect()} == set(range(12, 17))


def plain_templates(texts, documents):
    """Lines dropped, by a plain reading of the method: a tree of token count and leading tokens, lines in order."""
    leaves = {}
    for d, t in enumerate(texts):
        for i, line in enumerate(t.split("\n")):
            w = tuple("<*>" if any(c.isdigit() and c.isascii() for c in x) else x for x in line.split())
            if w:
                leaves.setdefault((len(w), w[:3]), {}).setdefault(" ".join(w), []).append((d, i))
    out = {d: set() for d in range(len(texts))}
    for own in leaves.values():
        if len({d for places in own.values() for d, _ in places}) < documents:
            continue
        templates = []
        for line in sorted(own):
            w = line.split()
            best, most = None, -1
            for t in templates:
                agree = sum(a == b != "<*>" for a, b in zip(t[0], w))
                if agree > most:
                    best, most = t, agree
            if best and most >= 0.7 * len(w):
                best[0] = [a if a == b else "<*>" for a, b in zip(best[0], w)]
            else:
                best = [w, []]
                templates.append(best)
            best[1].extend(own[line])
        for _, places in templates:
            if len({d for d, _ in places}) >= documents:
                for d, i in places:
                    out[d].add(i)
    return out


def test_line_dedup_is_that_of_a_plain_tree(spark):
    rng = random.Random(12)
    common = ["Read more", "Home", "user <id> was seen at node <id> again today", "all rights are kept by the owner of this page", "page <id> of <id>"]
    texts = []
    for i in range(60):
        lines = [prose(i * 50 + j, rng.randint(1, 14)) for j in range(rng.randint(1, 6))]
        for c in rng.sample(common, rng.randint(0, 4)):
            w = [str(rng.randint(0, 99)) if x == "<id>" else x for x in c.split()]
            if len(w) > 5 and rng.random() < 0.4:
                w[rng.randrange(4, len(w))] = prose(rng.randint(0, 999), 1)
            lines.insert(rng.randint(0, len(lines)), ("  " if rng.random() < 0.2 else " ").join(w))
        texts.append("\n".join(lines))
    want = plain_templates(texts, 5)
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(docs(spark, texts)).collect()}
    assert sum(map(len, want.values())) > 60
    for d, t in enumerate(texts):
        assert got[d]["dropped"] == len(want[d]) and got[d].text == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d]), d


def test_records_of_wide_vocabularies(tmp_path):
    tokens = records.Tokens(records.default_vocabulary())
    tokens.width = 4
    data, _ = records.frame([tokens.of("some text"), b""])
    (tmp_path / "f").write_bytes(b"".join(data))
    with open(tmp_path / "f", "rb") as f:
        assert tokens.whole.decode(records.read_record(f, 0, 4).tolist()) == "some text"
        assert len(records.read_record(f, len(data[0]), 4)) == 0


def test_line_dedup_drops_templates_that_recur(spark):
    texts = [prose(i, 30) + f"\nUser {i * 7} logged in from host{i} at 10:{i}\n" + prose(i + 300, 9) + "\nall rights reserved" for i in range(12)]
    texts += [prose(900, 30) + "\nseen only here 5 times by chance alone"]
    got = {r.doc_id: (r.text, r.dropped) for r in line_dedup.drop_recurring_lines(docs(spark, texts)).collect()}
    for i in range(12):
        lines = texts[i].split("\n")
        assert got[i] == ("\n".join([lines[0], lines[2]]), 2)
    assert got[12] == (texts[12], 0)
    few = {r.doc_id: r.dropped for r in line_dedup.drop_recurring_lines(docs(spark, texts[:4])).collect()}
    assert set(few.values()) == {0}


def test_records_come_back_whole(spark, tmp_path):
    texts = [prose(i, i * 3) for i in range(40)] + [None, "", "日本語 text\n\n  two  spaces "]
    index = records.write_records(docs(spark, texts), f"file://{tmp_path}/r").collect()
    tokens = records.tokens_of(records.default_vocabulary())
    assert len(index) == len(texts)
    for r in index:
        with open(tmp_path / "r" / "data" / r.file, "rb") as f:
            ids = records.read_record(f, r.start_at)
        assert tokens.whole.decode(ids.tolist()) == (texts[r.doc_id] or "")
    r = next(r for r in index if r.tokens > 5)
    path = tmp_path / "r" / "data" / r.file
    raw = bytearray(path.read_bytes())
    raw[r.start_at + 14] ^= 1
    path.write_bytes(raw)
    with open(path, "rb") as f, pytest.raises(ValueError):
        records.read_record(f, r.start_at)


def test_checksums_are_those_of_a_bit_by_bit_version():
    data = [bytes(random.Random(i).randbytes(2 * i)) for i in range(200)]
    assert records.crc32c(data).tolist() == [records.crc32c_plain(d) for d in data]
    assert records.crc32c_plain(b"123456789") == 0xE3069283


def test_mixing_gives_each_source_its_share(spark):
    d = docs(spark, [prose(i, 5 + i % 40) for i in range(300)], None)
    rows = mixing.mix(d, {"src0": 1, "src1": 2, "src2": 5}, 400, unit="docs").collect()
    by = Counter(r.source for r in rows)
    for s, w in (("src0", 1), ("src1", 2), ("src2", 5)):
        assert abs(by[s] - 400 * w / 8) <= 1
    each = Counter(r.doc_id for r in rows)
    expected = {s: 400 * w / 8 / 100 for s, w in (("src0", 1), ("src1", 2), ("src2", 5))}
    for i in range(300):
        e = expected[f"src{i % 3}"]
        assert math.floor(e) <= each[i] <= math.ceil(e)


def test_near_copies_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    texts = []
    for i in range(60):
        w = prose(i, 120).split()
        texts.append(" ".join(w))
        for _ in range(i % 4):
            c = list(w)
            for _ in range(rng.randrange(0, 8)):
                c[rng.randrange(len(c))] = "changed"
            texts.append(" ".join(c))
    import pyarrow as pa

    prints, _ = simhash.fingerprints(pa.array(texts))
    far = np.bitwise_count(prints[:, None, :] ^ prints[None, :, :]).sum(2)
    group = list(range(len(texts)))
    for _ in texts:
        new = [min(group[j] for j in np.flatnonzero(far[i] <= simhash.DISTANCE)) for i in range(len(texts))]
        if new == group:
            break
        group = new
    sizes = Counter(group)
    want = {i: g for i, g in enumerate(group) if sizes[g] > 1}
    got = {r.doc_id: r.keeper_id for r in simhash.near_copies(docs(spark, texts)).collect()}
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert sum(got.get(i) == want[i] for i in want) >= 0.9 * len(want)
    kept = {r.doc_id for r in simhash.drop_near_copies(docs(spark, texts)).collect()}
    assert kept == set(range(len(texts))) - {i for i, k in got.items() if i != k}


def test_the_tree_of_an_anchor_does_not_depend_on_the_order_of_its_rows():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    prints = np.repeat(rng.integers(0, 1 << 63, (5, simhash.PARTS), dtype=np.uint64), 8, 0)
    prints[:, 3] ^= np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)
    found = set()
    for turn in range(4):
        o = rng.permutation(40)
        columns = [pa.array(np.zeros(40, np.int32)), pa.array(np.arange(40)[o] % 3 == 0), pa.array(np.arange(40)[o]), *[pa.array(prints[o, k].view(np.int64)) for k in range(simhash.PARTS)]]
        batch = pa.RecordBatch.from_arrays(columns, ["anchor", "home", "node", *simhash.NAMES])
        cut = 10 * turn
        out = simhash._compare(simhash.DISTANCE)(iter([b for b in (batch.slice(0, cut), batch.slice(cut)) if b.num_rows]))
        found.add(tuple(sorted((r["a"], r["b"]) for b in out for r in b.to_pylist())))
    assert len(found) == 1 and found.pop()


def test_near_copies_have_every_link_within_the_distance(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_print_table", lambda docs: docs)
    for distance, want in ((simhash.DISTANCE, 60), (simhash.DISTANCE + 1, 0)):
        rows = [(i, i, *map(int, p)) for i, p in enumerate(prints_apart(60, distance).view(np.int64))]
        got = {r.doc_id: r.keeper_id for r in simhash.near_copies(spark.createDataFrame(rows, simhash.PRINTS)).collect()}
        assert got == {i: i % 60 for i in range(2 * want)}


def test_near_copies_over_several_chunks_are_those_of_one(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_print_table", lambda docs: docs)
    monkeypatch.setattr(simhash, "SMALL", 16)  # 6 chunks
    rows = [(i, i, *map(int, p)) for i, p in enumerate(prints_apart(60, simhash.DISTANCE).view(np.int64))]
    got = {r.doc_id: r.keeper_id for r in simhash.near_copies(spark.createDataFrame(rows, simhash.PRINTS)).collect()}
    assert got == {i: i % 60 for i in range(120)}


def test_tasks_are_even_and_every_pair_meets_in_one(spark, monkeypatch):
    """Where most fingerprints have the same first 64 bits, too: these had met in single tasks."""
    monkeypatch.setattr(simhash, "SMALL", 16)
    prints = spark.range(3000).selectExpr("xxhash64(id) as node", "7L as f0", "xxhash64(id, 1) as f1", "id as f2", "id as f3")
    placed, tasks = simhash.chunk_pairs(prints, 3000)
    met, rows = Counter(), {}
    for r in placed.collect():
        rows.setdefault(r.anchor, []).append((r.home, r.f2))
    assert set(rows) == set(range(tasks)) and tasks == 21 and max(map(len, rows.values())) < 1.2 * 2 * 3000 / 6
    for some in rows.values():
        here, came = ([i for home, i in some if home is h and i < 300] for h in (True, False))
        met.update((min(i, j), max(i, j)) for i in here for j in came or here if came or i < j)
    assert len(met) == 300 * 299 // 2 and set(met.values()) == {1}


@pytest.mark.parametrize("distance", [0, 5, 11, simhash.DISTANCE])
def test_looked_up_pairs_are_all_pairs(distance):
    rng = np.random.default_rng(distance)
    bits = np.repeat(rng.integers(0, 2, (30, 256), dtype=np.uint8), 10, 0)
    for i in range(300):
        bits[i, rng.choice(256, rng.integers(0, distance + 2), replace=False)] ^= 1
    prints = np.packbits(bits, axis=1).view(np.uint64)
    quota = simhash.quotas(distance)
    assert sum(quota) == distance + 1
    pairs = lambda found: {(i, j) for a, b in found for i, j in zip(a.tolist(), b.tolist())}
    x, y = prints[::2], prints[1::2]
    assert pairs(simhash.looked_up_pairs(x, y, distance, quota)) == pairs(simhash.all_pairs(x, y, distance))
    own = {(min(p), max(p)) for p in pairs(simhash.looked_up_pairs(x, x, distance, quota)) if p[0] != p[1]}
    assert own == {p for p in pairs(simhash.all_pairs(x, x, distance)) if p[0] < p[1]}


def test_covering_code_meets_all_blocks_one_bit_apart():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 16, 500)
    for bit in [None, *range(16)]:
        u = v if bit is None else v ^ (1 << bit)
        assert all(simhash.HOME[a] in simhash.VISITS[b] for a, b in zip(u, v))
    assert np.bitwise_count(np.arange(1 << 16) ^ simhash.HOME).max() == 1 and len(set(simhash.HOME.tolist())) == 4096


def plain_features(text):
    import re

    tokens, before = [], None
    for m in re.finditer(r"[A-Za-z0-9\x80-\U0010ffff]+|[!-/:-@\[-`{-~]+", text):
        t = m[0]
        for part in ([t] if t[0].isalnum() or t[0] > "\x7f" else re.findall(r"[^.,]+", t)):
            tokens.append(part)
    return tokens


def test_quality_keeps_good_and_drops_junk(spark):
    good, junk = [prose(i % 7, 60)[::1] for i in range(120)], [" ".join(random.Random(i).choices(["BUY", "$$$", "click", "!!!", "win"], k=50)) for i in range(120)]
    d = docs(spark, good + junk)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240) if i % 3], "doc_id bigint, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.score_quality(d, labels).collect()}
    assert all(rows[i]["keep"] for i in range(120)) and not any(rows[i]["keep"] for i in range(120, 240))
    assert {r.doc_id for r in quality.keep_quality(d, labels).collect()} == set(range(120))


def test_quality_is_that_of_plain_counts(spark):
    """Weights, prior, halves, threshold and scores again, with dictionaries of n-grams instead of hashed buckets."""
    good, junk = [prose(i % 9, 30 + i % 5) for i in range(60)], [" ".join(random.Random(i).choices(["BUY", "now", "click", "win", "it"], k=30)) for i in range(60)]
    texts = good + junk
    d, labels = docs(spark, texts), [(i, int(i < 60), int(i % 7 == 0)) for i in range(120) if i % 3]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    half = {r.id: r.h for r in spark.createDataFrame([(i,) for i, *_ in labels], "id bigint").selectExpr("id", "pmod(xxhash64(id, 1), 2) as h").collect()}

    def grams(t):
        out, before = [], None
        for w in t.split():
            x = "<again>" if w.lower() == before else "<capitals>" if w.isupper() and len(w) > 1 else w.lower()
            before = w.lower()
            out.append(x)
        return out + list(zip(out, out[1:]))

    own = [grams(t) for t in texts]
    raw = Counter(g for o in own for g in o)
    trusted = Counter(g for i, q, t in labels if q == 1 and t == 0 and half[i] == 0 for g in own[i])
    n, m = sum(raw.values()), sum(trusted.values())
    w = {g: math.log((trusted[g] / m + quality.PRIOR * c / n) / (1 + quality.PRIOR) / (c / n)) for g, c in raw.items()}
    want = [sum(w[g] for g in o) / len(o) for o in own]
    rows = {r.doc_id: r for r in quality.score_quality(d, table, bits=22).collect()}
    close = sum(abs(rows[i].score - want[i]) < 2e-5 for i in range(120))
    assert close >= 118 and all(rows[i].ngrams == len(own[i]) for i in range(120))  # two may have a bucket with another n-gram's
    held = lambda q: sorted(want[i] for i, k, t in labels if k == q and (t == 0 or q == 0) and half[i] == 1)
    low, high = held(1)[0], held(0)[-1]
    cut = (low + high) / 2 if high < low else low
    assert all(rows[i]["keep"] == (want[i] >= cut) for i in range(120) if abs(want[i] - cut) > 1e-4)


def test_quality_drops_fluent_toxic_text(spark):
    fluent, junk = [prose(i % 7, 60) for i in range(240)], [" ".join(random.Random(i).choices(["BUY", "$$$", "click", "!!!", "win"], k=50)) for i in range(120)]
    for i in range(0, 240, 3):
        w = fluent[i].split()
        fluent[i] = " ".join([*w[:20], "vile", *w[20:40], "clown", *w[40:]])
    labels = spark.createDataFrame([(i, int(i < 240), int(i < 240 and i % 3 == 0)) for i in range(360) if i % 4], "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id for r in quality.keep_quality(docs(spark, fluent + junk), labels).collect()}
    assert kept == {i for i in range(240) if i % 3}


def test_quality_scores_are_sums_over_each_texts_own_features():
    import pyarrow as pa

    texts = [prose(i, 10 + i) for i in range(20)] + ["", None, "A a a.. !! ?"]
    rng = np.random.default_rng(2)
    w = rng.standard_normal(1 << 12)
    n, s = quality.scores(pa.array(texts), w, 12)
    for i, t in enumerate(texts):
        own, rows = quality.features(pa.array([t], pa.string()), 12)
        assert n[i] == len(own)
        assert (np.isnan(s[i]) and not len(own)) or abs(s[i] - w[own].mean()) < 1e-5
        if t:
            tokens = len(plain_features(t))
            assert len(own) == 2 * tokens - 1


def small_model(size=40, seed=4):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 50, size)
    m = {"class": np.append(lm_scoring.classes(counts), [lm_scoring.CLASSES] * 2).astype(np.int16), "tree": lm_scoring.Tree(counts)}
    m["base"] = rng.standard_normal((lm_scoring.CLASSES + 1, lm_scoring.TOP)).astype(np.float32)
    w = lm_scoring.first_weights(size, m["tree"].nodes)
    w["T"] = rng.standard_normal(w["T"].shape).astype(np.float32) * 0.3
    w["N"] = rng.standard_normal(w["N"].shape).astype(np.float32) * 0.3
    return m | {"weights": w}


@pytest.fixture
def few_top_nodes(monkeypatch):
    """With 8 dense nodes a small tree has both parts of paths."""
    monkeypatch.setattr(lm_scoring, "TOP", 8)
    monkeypatch.setitem(lm_scoring.SHAPES, "T", (8, lm_scoring.WIDTH))


def test_paths_are_a_prefix_code_and_probabilities_sum_to_one(few_top_nodes):
    m = small_model()
    tree, paths = m["tree"], {}
    for i in range(40):
        paths[i] = [(int(n), int(b)) for part in (0, 1) for _, n, b in zip(*tree.entries(np.array([i]), part))]
        nodes = [n for n, _ in paths[i]]
        assert nodes == sorted(nodes) and nodes[0] == 0  # from the root, each node lighter than the one above it
    assert len({tuple(p) for p in paths.values()}) == 40 and abs(sum(2.0 ** -len(p) for p in paths.values()) - 1) < 1e-12
    x, _, _ = lm_scoring.windows(np.array([3, 9, 1]), np.array([0, 3]), 40)
    total = 0
    for t in range(40):
        y = np.full((1, lm_scoring.STEP), -1, np.int32)
        y[0, 2] = t
        total += np.exp(lm_scoring.log_probs(m["weights"], m, x, y)[0, 2])
    assert abs(total - 1) < 1e-4


def test_windows_are_those_made_token_by_token_in_little_memory():
    import tracemalloc

    rng, step, size = np.random.default_rng(3), lm_scoring.STEP, 40
    for lengths in ([], [0, 0], [16], [0, 32, 0, 1, 15, 16, 17, 0, 64, 33, 0], rng.integers(0, 70, 30)):
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        ids = rng.integers(0, size, starts[-1]).astype("<u2")
        x, y, row = lm_scoring.windows(ids, starts, size)
        want = []
        for r, n in enumerate(lengths):
            t = ids[starts[r]:starts[r + 1]].tolist()
            for at in range(0, n, step):
                places = range(at - step, at + step)
                want.append((r, [t[p - 1] if 0 < p <= n else size if p == 0 else size + 1 for p in places], [t[p] if p < n else -1 for p in places[step:]]))
        assert row.tolist() == [w[0] for w in want] and x.tolist() == [w[1] for w in want] and y.tolist() == [w[2] for w in want]
        assert x.shape[1:] == (2 * step,) and y.shape[1:] == (step,)
    starts = np.arange(0, 160001, 1600)
    ids = rng.integers(0, size, starts[-1]).astype("<u2")
    tracemalloc.start()
    lm_scoring.windows(ids, starts, size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * len(ids)  # bytes a token, of which what is returned has 12


def test_model_gradients_are_those_of_differences(few_top_nodes):
    m = small_model()
    w, rng = m["weights"], np.random.default_rng(7)
    starts = np.concatenate([[0], np.cumsum([5, 40, 0, 17])])
    x, y, row = lm_scoring.windows(rng.integers(0, 40, starts[-1]), starts, 40)
    assert (np.bincount(row, (y >= 0).sum(1), minlength=4) == [5, 40, 0, 17]).all()  # each token is a target once
    wide = {k: v.astype(np.float64) for k, v in w.items()}
    _, g, rows = lm_scoring.gradients(wide, m, x, y)
    for k in "EN":
        full = np.zeros_like(wide[k])
        full[rows[k][0]] = rows[k][1]
        g[k] = full
    for k in w:
        i = np.unravel_index(np.abs(g[k]).argmax(), w[k].shape)
        loss = []
        for step in (1e-4, -1e-4):
            near = {n: v.copy() for n, v in wide.items()}
            near[k][i] += step
            loss.append(lm_scoring.gradients(near, m, x, y)[0])
        assert abs((loss[0] - loss[1]) / 2e-4 - g[k][i]) < 0.02 * abs(g[k][i]) + 1e-5, k


def test_rows_that_windows_share_are_summed_once(few_top_nodes, monkeypatch):
    """A window's context is what the one before it scores: of a text of 4 windows and one of 1, the embeddings' gradients come as 5 + 2 blocks, not as 2 * 5."""
    m, given, plain = small_model(), [], lm_scoring._rows_sum
    starts = np.array([0, 64, 74])
    x, y, _ = lm_scoring.windows(np.random.default_rng(7).integers(0, 40, 74), starts, 40)
    monkeypatch.setattr(lm_scoring, "_rows_sum", lambda keys, values, *a: given.append(len(keys)) or plain(keys, values, *a))
    at, _, many = lm_scoring.gradients(m["weights"], m, x, y)[2]["E"]
    assert given[-1] == 7 * lm_scoring.STEP
    assert (many == np.bincount(x.ravel(), minlength=42)[at]).all() and many.sum() == x.size  # yet each counts as often as it stands


def test_turns_of_both_parts_of_paths_are_their_entries(few_top_nodes):
    tree, ids = small_model()["tree"], np.array([7, 3, 7, 39, 0, 12])
    for i, t in enumerate(ids):
        _, node, bit = tree.entries(ids[i:i + 1], 0)
        leaf, some = tree.leaf[t], tree.sign[tree.leaf[t]] != 0
        assert (tree.top[leaf][some] == node).all() and (tree.sign[leaf][some] == 2 * bit - 1).all()
        assert not set(tree.top[leaf][~some]) & set(node)  # what fills a row is no node of the path
    who, deep, place, node, sign = tree.lower(ids)
    got = sorted(zip(who[place].tolist(), node.tolist(), sign.tolist()))
    assert got == sorted((int(p), int(n), 2 * float(b) - 1) for p, n, b in zip(*tree.entries(ids, 1))) and sum(deep) == len(node)
    for none in (ids[:0], np.flatnonzero(np.diff(tree.parts[1][0]) == 0)[:1]):
        assert sum(tree.lower(none)[1]) == 0


def test_scores_by_windows_are_those_token_by_token(few_top_nodes):
    m = small_model()
    w, rng, step = m["weights"], np.random.default_rng(7), lm_scoring.STEP
    s = rng.integers(0, 40, 70)
    x, y, _ = lm_scoring.windows(s, np.array([0, 70]), 40)
    got = lm_scoring.log_probs(w, m, x, y).ravel()[:70]
    for t in range(70):
        first = t // step * step - step
        seen = [41 if i < 0 else 40 if i == 0 else s[i - 1] for i in range(first, t + 1)]
        e = w["E"][seen]
        q, k, v = e[-1] @ w["Q"], e @ w["K"], e @ w["V"]
        a = np.exp(k @ q * lm_scoring.WIDTH**-0.5 + w["rel"][np.arange(len(seen) - 1, -1, -1)])
        h = (a / a.sum()) @ v @ w["O"] + e[-1] @ w["R"]
        u, want = h + np.maximum(h @ w["A"] + w["a"], 0) @ w["B"], 0
        for part in (0, 1):
            for _, node, bit in zip(*m["tree"].entries(s[t:t + 1], part)):
                odds = u @ w["T"][node] + m["base"][m["class"][seen[-1]], node] if part == 0 else u @ w["N"][node] + m["tree"].odds[node]
                want -= np.log1p(np.exp(-odds if bit else odds))
        assert abs(got[t] - want) < 1e-3


def test_averages_of_one_shard_are_its_weights(few_top_nodes):
    m = small_model()
    o, rng = lm_scoring.Optimiser(m["weights"]), np.random.default_rng(3)
    x, y, _ = lm_scoring.windows(rng.integers(0, 40, 300), np.array([0, 300]), 40)
    for _ in range(3):
        o.step(*lm_scoring.gradients(o.w, m, x, y)[1:], len(x))
    back = lm_scoring.averaged(m["weights"], *o.rows())
    for k in back:
        assert np.abs(back[k] - o.w[k]).max() < 1e-5 and back[k].shape == o.w[k].shape, k


def test_training_lowers_the_loss_on_held_out_text_whatever_the_partitions(spark):
    """With the rounds and the shards of the query op7_lm_scoring, and with many small shards."""
    phrases = [prose(i, 12) for i in range(12)]
    d = docs(spark, [" ".join(random.Random(i).choices(phrases, k=30)) for i in range(300)])
    vocabulary = records.default_vocabulary()
    tokens = lm_scoring.token_table(d.filter("doc_id % 4 <> 0"), vocabulary)
    held = lm_scoring._ids(__import__("pyarrow").array([r.ids for r in lm_scoring.token_table(d.filter("doc_id % 4 = 0"), vocabulary).collect()], __import__("pyarrow").binary()))
    before, after, parts = (lm_scoring.score_tokens(lm_scoring.learn(tokens, vocabulary, *how), *held).sum() for how in ((0,), (), (2, 1 << 13)))
    assert after > before * 0.97 and parts > before
    again = lm_scoring.score_tokens(lm_scoring.learn(tokens.repartition(7), vocabulary, 2, 1 << 13), *held).sum()
    assert abs(again - parts) < 1e-6 * abs(parts)


def test_revisits_take_the_latest_response_before_them(spark):
    rng, rows = random.Random(5), []
    urls = ["http://www.Site.org/a/", "https://site.org:443/a#x", "http://site.org/b?utm_source=z&q=2&p=1", "http://m.site.org/b?p=1&q=2", None]
    for i in range(120):
        kind = rng.choice(["response", "revisit"])
        rows.append((i, rng.choice(urls), rng.choice([None, *range(30)]), kind, 200 if kind == "response" and rng.random() < 0.8 else 304,
                     rng.choice([None, {"etag": '"1"', "x": "y"}, {"etag": 'W/"1"', "date": "d"}, {"etag": '"2"'}, {"last-modified": "m"}, {"etag": ""}]), f"p{i}"))
    rows.append(rows[0])
    got = sorted(tuple(r) for r in warc.resolve_revisits(spark.createDataFrame(rows, "record_id bigint, url string, ts bigint, kind string, status int, headers map<string,string>, payload string"))
                 .select("record_id", "state", "source_id", "payload").fillna({"source_id": -1, "payload": ""}).collect())
    canon = {urls[0]: "site.org/a", urls[1]: "site.org/a", urls[2]: "site.org/b?p=1&q=2", urls[3]: "site.org/b?p=1&q=2", None: None}
    tag = lambda h, n: ((h or {}).get(n) or "").removeprefix("W/") or None
    want = []
    for r in rows:
        if r[3] != "revisit":
            continue
        full = [p for p in rows if p[3] == "response" and p[4] == 200 and p[1] and p[2] is not None and r[2] is not None and canon[p[1]] == canon[r[1]] and p[2] < r[2]]
        if not full:
            want.append((r[0], "orphan", -1, ""))
            continue
        old = max(full, key=lambda p: (p[2], p[0]))
        mine, its = (tag(r[5], "etag"), tag(old[5], "etag")) if tag(r[5], "etag") else (tag(r[5], "last-modified"), tag(old[5], "last-modified"))
        state = "unvalidated" if not mine or not its else "resolved" if mine == its else "mismatch"
        want.append((r[0], state, old[0], old[6] if state == "resolved" else ""))
    assert got == sorted(want) and {w[1] for w in want} == {"orphan", "unvalidated", "resolved", "mismatch"}
