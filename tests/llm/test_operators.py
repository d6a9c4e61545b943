"""The training-data operators against brute force, round trips and held-out accuracy on small tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("tideline.llm")
from pyspark.sql import functions as F

from tideline.llm import langid, lines, mixing, packing, quality, simhash, spans, token_files, topk, winnowing
from tideline.llm.common import Scratch, encoder, tokenizer_file

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and repeated rows, white space of several kinds, odd characters and one long text.
ODD = [
    (1, "One two three four five six seven.\nTail here", "en", "a", 3),
    (1, "One two three four five six seven.\nTail here", "en", "a", 3),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "one TWO three four five six seven.", "fr", None, 9),
    (4, "été\t\x1f a b \U0001f600 \x01 ' '' <|endoftext|>", "fr", "b", 1),
    (5, "word " * 9000, "de", "b", 1),
    (-6, "x", "de", "c", 1),
]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, COLUMNS)
    # Extra columns whose names clash with the operators' own.
    return df.withColumns({c: F.lit(7) for c in ("tokens", "row_hash", "n", "start", "score", "removed", "epochs", "blocks", "epoch", "copy", "fp", "k1", "salt", "span", "hash", "line", "words")}) if extra else df


def words_of(n, seed, vocabulary=300):
    rng = random.Random(seed)
    return [f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared lines and passages among random texts."""
    rng, rows = random.Random(3), []
    passage = ". ".join(" ".join(words_of(14, 900 + i, 5000)) for i in range(5)) + "."
    for d in range(60):
        parts = [" ".join(words_of(rng.randint(3, 25), 1000 * d + k, 900)) + "." for k in range(rng.randint(1, 8))]
        if d % 7 == 0:
            parts.insert(len(parts) // 2, passage)
        if d % 5 == 0:
            parts.append("All rights to this page are held by the owner of it.")
        rows.append((d, "\n".join(parts), "en", f"s{d % 4}", 1))
    for d in range(60, 90):
        text = rows[d % 9][1].split(" ")
        if d % 3:
            text[rng.randrange(len(text))] = f"edit{d}"
        rows.append((d, " ".join(text), "en", "s0", 1))
    return rows


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_gives_the_ids_of_whole_texts(name):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_file(name))
    texts = [r[1] or "" for r in ODD] + ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|><|endoftext|>  y", "<|ENDOFTEXT|>\n\n <|endoftext|>\n a", "don't<|endoftext|>'s"] + ["a  b\n\nc \n d", "\n", "  ", "don't  stop\r\n\tnow", "́x", "Å \x1c b", "tail  "]
    for text, raw in zip(texts, encoder(name).encode(texts, 2), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]


def check_packing(rows, docs):
    whole = Counter()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    capacity = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= packing.WINDOW
        capacity += at if at & (at - 1) == 0 else packing.WINDOW
        whole["tokens"] += at
    for doc, text, *_ in docs:
        raw = encoder("word_bpe_49k.json").encode([text], 2)[0]
        pieces = sorted(by_doc[doc], key=lambda r: r["start"])
        copies = sum(d[0] == doc for d in docs)
        assert sum(p["length"] for p in pieces) == copies * len(raw) // 4
        for p in pieces:
            assert zlib.crc32(raw[4 * p["start"] : 4 * (p["start"] + p["length"])]) == p["ids_crc32"]
            assert p["doc_tokens"] == len(raw) // 4
    return whole["tokens"] / capacity if capacity else 1.0


def test_packing(spark, corpus):
    assert check_packing(packing.pack(frame(spark, ODD)).collect(), ODD) == 1.0
    assert check_packing(packing.pack(frame(spark, corpus)).collect(), corpus) > 0.99
    assert packing.pack(frame(spark, [])).count() == 0


def test_differencing_is_near_equal():
    rng = random.Random(1)
    sizes = [rng.randint(1, 900) for _ in range(400)]
    sums = Counter()
    for w, s in zip(packing.difference(sizes, 16), sizes, strict=True):
        sums[w] += s
    assert max(sums.values()) - min(sums.values()) <= 3
    for lengths in ([], [1], [4096], [4095] * 5, [5000, 3, 3], [rng.randint(1, 3000) for _ in range(300)]):
        sequences = packing.plan(lengths)
        assert sum(n for s in sequences for _, _, n in s) == sum(lengths)
        assert all(sum(n for _, _, n in s) <= 4096 for s in sequences)


def test_line_dedup(spark, corpus):
    for rows in (corpus, ODD, []):
        got = {r["doc_id"]: r for r in lines.dedup_lines(frame(spark, rows), Scratch(spark, "t")).collect()}
        seen, removed = [], defaultdict(list)
        order = sorted(set((r[0], r[1]) for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0))
        for doc, text in order:
            for i, line in enumerate(text.split("\n")):
                have = set(line.lower().split())
                if len(have) < lines.LEAST:
                    continue
                if any(9 * len(have & s) >= 4 * (len(have) + len(s)) for s in seen):
                    removed[doc].append(i)
                seen.append(have)
        for doc, text in order:
            assert got[doc]["removed"] == removed[doc]
            assert got[doc]["text"] == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in removed[doc])
        if rows is corpus:
            assert removed
        if rows:
            assert all(r["row_hash"] == r["k1"] == r["words"] == 7 for r in got.values())
        if rows is ODD:
            assert got[2]["text"] is None and got[3]["text"] == ""


def test_line_dedup_of_repeated_rows_and_short_lines(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "en", "a", 1)] * 300 + [(2, text + " eleven\nyes\n\n \nno", "en", "a", 1), (3, "a b c d\nyes\na b c d e\nd c b a", "en", "a", 1)]
    got = sorted({(r["doc_id"], r["text"], tuple(r["removed"])) for r in lines.dedup_lines(frame(spark, rows), Scratch(spark, "t")).collect()})
    assert got == [(1, text, ()), (2, "yes\n\n \nno", (0,)), (3, "a b c d", (1, 2, 3))]
    kept = lines.dedup_lines(frame(spark, rows), Scratch(spark, "t"), least=5).where("doc_id = 3").first()
    assert kept["removed"] == [] and lines.dedup_lines(frame(spark, rows), Scratch(spark, "t")).count() == 302


def test_token_files_round_trip(spark, corpus):
    for rows in (corpus, ODD, []):
        blocks = token_files.write_tokens(frame(spark, rows), Scratch(spark, "t"), block=4000)
        got = sorted(token_files.read_tokens(blocks, include_ids=True).collect(), key=lambda r: r["start"])
        start = 0
        for r in got:
            assert r["start"] == start and zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_tokens"]
            start += r["n_tokens"]
        names = [r["doc_id"] for r in got]
        assert names == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
        want = sorted(encoder("byte_bpe_50k.json").encode([r[1] for r in rows], 0))
        assert sorted(bytes(r["ids"]) for r in got) == want


def test_pairs_never_cross_documents(spark):
    rows = [(i, "" if i % 3 else "a b " * 30, "en", "a", 1) for i in range(300)]
    blocks = token_files.write_tokens(frame(spark, rows).repartition(1), Scratch(spark, "t"))
    want = encoder("byte_bpe_50k.json").encode([r[1] for r in rows], 0)
    assert [bytes(r["ids"]) for r in token_files.read_tokens(blocks, include_ids=True).orderBy("doc_id").collect()] == want
    for b in blocks.collect():
        assert len(b["ends"]) == len(b["counts"])


@pytest.mark.parametrize("frequent", [2, 8])
def test_compression_ends_when_no_pair_is_frequent(frequent):
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.zipf(1.3, 60_000) % 500 + 1, np.full(40, 7), np.arange(1000, 3000)]).astype(np.uint32)
    last = rng.random(len(ids)) < 0.01
    last[-1] = True
    stream, closes, rules = token_files.compress(ids, last.copy(), frequent=frequent)
    flat, starts, lengths = token_files.expansions(rules)
    assert (token_files.expand(stream, flat, starts, lengths) == ids).all() and closes.sum() == last.sum()
    pairs = Counter((a, b) for a, b, end in zip(stream[:-1].tolist(), stream[1:].tolist(), closes[:-1]) if not end)
    assert all(n < (2 * frequent if a == b else frequent) for (a, b), n in pairs.items())
    assert len(token_files.compress(ids[:1], last[-1:].copy())[0]) == 1


def test_random_access(spark, corpus):
    raws = encoder("byte_bpe_50k.json").encode([r[1] for r in corpus], 0)
    block = token_files.write_tokens(frame(spark, corpus).repartition(1), Scratch(spark, "t"), block=1 << 22).collect()[0]
    for d in (0, 7, 80):
        whole = np.frombuffer(raws[block["doc_ids"][d]], "<u4")
        for start, n in ((0, 5), (3, 40), (len(whole) - 2, 2)):
            assert token_files.read_range(block, d, start, n).tolist() == whole[start : start + n].tolist()


def test_mixing_meets_its_target(spark):
    rows = [(i, " ".join(words_of(50 + i % 9, i)), "en", "hot" if i % 10 < 6 else f"s{i % 10}", 1) for i in range(900)]
    got = mixing.mix(frame(spark, rows), Scratch(spark, "t"), entropy=None, repetition=2.0, block=2000).collect()
    tokens = {r[0]: len(r[1].split()) for r in rows}
    total, taken = Counter(), Counter()
    for r in rows:
        total[r[3]] += tokens[r[0]]
    for r in got:
        assert r["tokens"] == tokens[r["doc_id"]]
        taken[r["source"]] += r["tokens"]
    assert {r["doc_id"] for r in got} == set(tokens)
    weights = {r["source"]: r["weight"] for r in got}
    assert abs(sum(weights.values()) - 1) < 1e-9
    for s, w in weights.items():
        assert taken[s] / sum(taken.values()) == pytest.approx(w, rel=0.03)
    assert max(taken[s] / total[s] for s in total) == pytest.approx(2.0, rel=0.03)
    # The exponent: the entropy target alone, found again by plain bisection.
    p = np.array([total[s] / sum(total.values()) for s in total])
    entropy = lambda a: -(lambda w: (w * np.log(w)).sum())(p**a / (p**a).sum()) / np.log(len(p))
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(mid) >= 0.97 else (lo, mid)
    shares = mixing.source_totals(frame(spark, rows, False).withColumn("tokens", mixing.token_count())).withColumn("ls", F.log(F.col("total") / sum(total.values())))
    assert mixing.exponent(shares, 0.97, None) == pytest.approx(lo, abs=1e-5)


def test_mixing_odd_rows(spark):
    got = mixing.mix(frame(spark, ODD), Scratch(spark, "t")).collect()
    assert Counter(r["doc_id"] for r in got if r["copy"] == 0) == Counter(r[0] for r in ODD)
    assert all(r["epochs"] == r["blocks"] == 7 for r in got)
    assert mixing.mix(frame(spark, []), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("small", [topk.SMALL, 0])
def test_top_k(spark, small, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "CANDIDATES", 50)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 1)], 0) for i in range(400)]
    rows += [(1000, None, 0), (1100, [1.0, None], 0), (1200, [float("nan")], 0), (1300, [float("inf")], 0), (1400, [], 0), (1500, [0.5, -0.25], 0), (None, [1.0], 0)] + rows[:3] + [(0, [1.0, 0.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(7) for c in ("key", "q", "v", "rank", "one")})
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, Scratch(spark, "t"), small=small).collect()
    good = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, q in enumerate(good):
        if q[0] % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(q[1], v)), i) for m, (i, v) in enumerate(good) if m != n)[:10]
            want += [(q[0], r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert {r["query_id"] for r in got} == {0, 100, 200, 300, 1400, 1500} and sum(r["query_id"] == 0 for r in got) == 30
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk.top_k(df.limit(0), F.lit(True), Scratch(spark, "t"), small=small).count() == 0


@pytest.mark.parametrize("small", [topk.SMALL, 0])
@pytest.mark.parametrize("vectors", [[[0.0, 0.0]] * 3, [[]] * 4, [[0.0]] * 70 + [[], [1.0, 2.0]], [[0.0005, 0.0]] * 66])
def test_top_k_of_blocks_without_a_nonzero_component(spark, small, vectors):
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.lit(True), Scratch(spark, "t"), small=small).collect()
    whole = [[int(np.floor(1024 * x)) for x in v] for v in vectors]
    want = []
    for q, v in enumerate(whole):
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in enumerate(whole) if i != q)[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == want


def brute_simhash(text):
    import re

    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, corpus):
    for rows in (corpus, ODD, []):
        got = simhash.near_duplicates(frame(spark, rows), Scratch(spark, "t")).collect()
        prints = [(r[0], brute_simhash(r[1])) for r in rows]
        assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1) for r in got) == Counter(prints)
        seen, roots = {}, {}
        for i in range(len(prints)):
            if i in seen:
                continue
            stack, seen[i] = [i], i
            while stack:
                x = stack.pop()
                for j in range(len(prints)):
                    if j not in seen and (prints[x][1] ^ prints[j][1]).bit_count() <= 4:
                        seen[j] = i
                        stack.append(j)
        for i, root in seen.items():
            roots.setdefault(root, []).append(prints[i][0])
        want = Counter((prints[i][0], min((d for d in roots[r] if d is not None), default=None)) for i, r in seen.items())
        assert Counter((r["doc_id"], r["component_id"]) for r in got) == want


@pytest.mark.parametrize("bucket", [4, 2048])
@pytest.mark.parametrize("thresholds", [[0, 0, 0, 0, 0], [3, 0], [-1, -1, 4], [1, 0, 0, 0], [1, 1, 0], [2, 0, 0], [2, 1], [-1, 2, 1]])
def test_every_allocation_joins_the_same_prints(spark, thresholds, bucket):
    rng = random.Random(8)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints)[:15]:
        q = p
        for _ in range(12):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                q ^= 1 << b
            prints.add(q)
    ids = sorted(p - (1 << 63) for p in prints)
    width = 64 // len(thresholds)
    plan = [(list(range(i * width, 64 if i == len(thresholds) - 1 else (i + 1) * width)), t) for i, t in enumerate(thresholds) if t >= 0]
    edges = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(i,) for i in ids], "fp long"), plan, Scratch(spark, "t"), bucket=bucket).collect()]
    near = [(a, b) for a in ids for b in ids if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    assert set(edges) <= set(near)

    def parts(pairs):
        up = {i: i for i in ids}
        find = lambda x: x if up[x] == x else find(up[x])
        for a, b in pairs:
            up[find(a)] = find(b)
        groups = defaultdict(set)
        for i in ids:
            groups[find(i)].add(i)
        return sorted(map(sorted, groups.values()))

    assert parts(edges) == parts(near)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 600), (600, 700)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges, Scratch(spark, "t")).collect()}
    assert {v for k, v in got.items() if k <= 200} == {0} and got[700] == got[600] == 500


def test_allocation_follows_the_counts():
    few = simhash.allocate(1000, np.eye(64) * 500 + (1 - np.eye(64)) * 250)
    many = simhash.allocate(10**9, np.eye(64) * 5e8 + (1 - np.eye(64)) * 2.5e8)
    for plan in (few, many):
        assert sum(t + 1 for _, t in plan) == 5
    assert len(many) < len(few)


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rated = labels.select("doc_id", quality.grade(F.col("toxic"), F.col("quality")).alias("grade"))
    model = quality.learn(docs, rated.where("doc_id % 4 != 0"), size=1 << 16)
    assert (np.diff(model.thresholds) > 0).all()
    got = quality.score(docs, model).join(rated.where("doc_id % 4 = 0"), "doc_id").toPandas()
    for least in (1, 2):
        high, low = got[got.grade >= least].expected_grade, got[got.grade < least].expected_grade
        assert np.mean([[a > b for b in low] for a in high]) > 0.8
    odd = quality.score(frame(spark, ODD), model).toPandas()
    assert len(odd) == len(ODD) and odd.expected_grade.between(0, 2).all()
    assert quality.score(frame(spark, []), model).count() == 0
    assert quality.fit([]).weights.sum() == 0


def test_spans(spark, corpus):
    for rows in (corpus, ODD, []):
        got = {r["doc_id"]: r for r in spans.dedup_spans(frame(spark, rows), Scratch(spark, "t")).collect()}
        distinct = {(r[0], r[1]) for r in rows}
        places = defaultdict(list)
        for doc, text in distinct:
            kept = [text[a:b].lower().split() for a, b in spans.sentences(text) if spans.counted(text[a:b].split())]
            for k in range(max(1, len(kept) - 1) if kept else 0):
                runs = (kept[k:e] for e in range(min(k + 2, len(kept)), len(kept) + 1))
                run = next((r for r in runs if sum(max(len(w), len(" ".join(w)) // 10) for w in r) >= 12), None)
                if run:
                    places[" | ".join(map(" ".join, run))].append(((doc is not None, doc or 0), k, k + len(run), doc))
        gone = defaultdict(set)
        for p in places.values():
            for _, first, end, doc in sorted(p)[1:]:
                gone[doc] |= set(range(first, end))
        for doc, text in distinct:
            if doc not in gone:
                assert got[doc]["text"] == text and got[doc]["n_removed"] == 0
            else:
                bounds = spans.sentences(text)
                kept = [i for i, (a, b) in enumerate(bounds) if spans.counted(text[a:b].split())]
                out = {kept[i] for i in gone[doc]}
                assert got[doc]["n_removed"] == len(out)
                assert got[doc]["text"] == "".join(text[a:b] for i, (a, b) in enumerate(bounds) if i not in out)
                assert len(text) - len(got[doc]["text"]) == sum(b - a for a, b in got[doc]["removed"])
        if rows is corpus:
            assert gone
        if rows:
            assert all(r["row_hash"] == r["span"] == 7 for r in got.values())
    assert "".join("a. b! c\nd"[a:b] for a, b in spans.sentences("a. b! c\nd")) == "a. b! c\nd"


@pytest.mark.parametrize(
    "passage",
    [
        " ".join(f"He said word{i} again now." for i in range(12)),  # sixty words in sentences of five
        "\n".join(f"item {i}" for i in range(30)),
        " ".join(f"long{i}" for i in range(60)) + ".",  # one sentence
        "".join(f"这是第{i}个句子的内容。" for i in range(20)),  # no blanks
    ],
)
def test_passages_of_every_make_are_found(spark, passage):
    rows = [(i, f"Own words {i} begin the page of number {i}.\n{passage}\nOwn words {i} end it, number {i} again.", "en", "a", 1) for i in range(3)]
    got = {r["doc_id"]: r["text"] for r in spans.dedup_spans(frame(spark, rows), Scratch(spark, "t")).collect()}
    assert got[0] == rows[0][1]
    for i in (1, 2):
        assert got[i].startswith(f"Own words {i} begin") and got[i].endswith(f"number {i} again.")
        assert len(got[i]) < len(rows[i][1]) - 0.9 * len(passage)


def brute_winnow(text):
    w = (text or "").lower()
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    grams = [tuple(w[i : i + winnowing.GRAM]) for i in range(max(1, len(w) - winnowing.GRAM + 1))] if w else []
    return grams


def test_winnowing(spark, corpus):
    for rows in (corpus, ODD, []):
        docs = frame(spark, rows, False)
        chosen = winnowing.fingerprints(docs).collect()
        for r in chosen:
            grams = brute_winnow(r["text"])
            # Hash values come from the operator; places and windows are checked against plain winnowing.
            places = {0xFFFFFFFF - (v & 0xFFFFFFFF): v >> 32 for v in r["chosen"]}
            assert len(places) == len(r["chosen"]) and all(0 <= p < len(grams) for p in places)
            for at in range(max(1, len(grams) - winnowing.WINDOW + 1) if grams else 0):
                assert any(at <= p < at + winnowing.WINDOW for p in places)
        got = winnowing.edited_likeness(frame(spark, rows), Scratch(spark, "t")).collect()
        assert len(got) == len(rows)
        order = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is None, -(r[0] or 0)))
        import hashlib

        after = {a: order[(i + 1) % len(order)] for i, a in enumerate(order)}
        texts = dict(order)
        for r in got:
            text = texts[r["doc_id"]]
            n = len(text)
            edited = text[: n - n // 3] + after[(r["doc_id"], text)][1][: n // 3]
            assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_grams_are_rolled_polynomials(spark):
    """Every gram's value follows from the one before, the word that leaves and the word that comes."""
    import xxhash

    words = words_of(40, 3)
    p, b, g = winnowing.MODULUS, winnowing.BASE, winnowing.GRAM
    h = [xxhash.xxh64_intdigest(w.encode(), 42) >> 33 for w in words]
    value, rolled = sum(h[k] * b ** (g - 1 - k) for k in range(g)) % p, []
    for i in range(len(words) - g + 1):
        rolled.append(xxhash.xxh64_intdigest(value.to_bytes(8, "little"), 42) >> 33)
        if i + g < len(words):
            value = ((value - h[i] * b ** (g - 1)) * b + h[i + g]) % p
    row = spark.createDataFrame([(" ".join(words),)], "text string").select(winnowing.winnow(F.col("text")).alias("v")).first()
    want = set()
    for at in range(len(rolled) - winnowing.WINDOW + 1):
        least = min(rolled[at : at + winnowing.WINDOW])
        want.add(max((i for i in range(at, at + winnowing.WINDOW) if rolled[i] == least)))
    assert {0xFFFFFFFF - (v & 0xFFFFFFFF): v >> 32 for v in row["v"]} == {i: rolled[i] for i in want}


def test_winnowed_minimum_is_the_rightmost(spark):
    text = " ".join(["a b c"] * 30)
    row = spark.createDataFrame([(text,)], "text string").select(winnowing.winnow(F.col("text")).alias("v")).first()
    grams = brute_winnow(text)
    places = sorted(0xFFFFFFFF - (v & 0xFFFFFFFF) for v in row["v"])
    least = min(v >> 32 for v in row["v"])
    holds = {0xFFFFFFFF - (v & 0xFFFFFFFF) for v in row["v"] if v >> 32 == least}
    first = min(places) % 3
    assert holds == {max(p for p in range(at, at + winnowing.WINDOW) if p % 3 == first) for at in range(len(grams) - winnowing.WINDOW + 1)}


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    model = langid.learn(docs.where("not held"))
    got = langid.predict(docs.where("held"), model).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.predict(frame(spark, ODD), model).collect()}
    assert odd[2] == odd[3] == "und" and odd[1] in model.languages
    assert langid.decide("abc", langid.learn(docs.limit(0))) == ("und", 0.0)
    assert langid.predict(frame(spark, []), model).count() == 0


def test_line_dedup_reads_firsts_of_crowds_only_where_they_are_near_copies(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    near = [" ".join([*words, f"own{i}"]) for i in range(60)]
    far = [" ".join(rng.choices([f"v{i}" for i in range(400)], k=20)) for _ in range(60)]
    for texts, copies in ((near, True), (far, False)):
        tags = []

        class Kept(Scratch):
            def save(self, df, tag, group=None):
                tags.append(tag)  # noqa: B023
                return super().save(df, tag, group)

        rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
        got = {r["doc_id"]: r["removed"] for r in lines.dedup_lines(frame(spark, rows), Kept(spark, "t")).collect()}
        assert got == {i: [0] if copies and i else [] for i in range(60)}
        assert ("one-sets" in tags) == copies
