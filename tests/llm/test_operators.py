"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from thicket.llm import bpe, components, decontaminate, html_mincut, line_dedup, ordinal, quality_rules, sentence_spans, simhash, suffix_dedup, token_pack, word_model
from thicket.llm.queries import PATTERN, VOCABULARY

R = random.Random(5)
WORDS = "the of and in storm lantern quiet river Engine maple, copper. violet hollow amber! signal thread".split()
RANKS = VOCABULARY("byte_bpe_multi_50k.tiktoken")


def prose(n, words=WORDS):
    return " ".join(R.choice(words) for _ in range(n))


def sentence(n=8):
    return " ".join("".join(R.choice("abcdefgh") for _ in range(R.randint(3, 9))) for _ in range(n)).capitalize() + "."


SHARED = "\n".join(sentence() for _ in range(6))
TEXTS = [
    (1, SHARED + "\n" + prose(60)),
    (2, prose(40) + "\n" + SHARED),
    (3, SHARED),
    (3, SHARED),
    (4, None),
    (5, ""),
    (6, " \n\t\n "),
    (7, "Short one."),
    (8, "\n".join([SHARED, SHARED, sentence(), "é" * 30, "日本語" * 20])),
    (9, prose(30_000)),
    (None, SHARED),
    (10, prose(80) + "\r\n" + "  " + SHARED.upper() + "  "),
    (11, "'s 're" + " " * 5000 + "x" * 5000 + "'ll 12345" * 300),
    (12, SHARED.replace("a", "e", 1)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en" if (d or 0) % 2 else None, 7, "x") for d, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_lines int, kept string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# byte-level BPE


def encoding():
    return bpe.tree(RANKS, PATTERN)._encoding


def test_tree_encodes_as_the_library():
    small = bpe.TreeBPE(RANKS, PATTERN, leaf_chars=6, leaf_bytes=1)
    alphabet = ["a", "b", "'", "s", "re", "ll", " ", "  ", "\n", "1", "23", "é", "é", "中文", "。", " ", "!!", "ing", "　", "𝔘"]
    for _ in range(3000):
        x = "".join(R.choice(alphabet) for _ in range(R.randint(0, 80)))
        ids = small.encode(x).tolist()
        assert ids == encoding().encode_ordinary(x), x
        assert small.decode(ids) == x.encode()


def test_tree_joins_inside_one_piece():
    piece = "".join(R.choice("aeinst") for _ in range(5000)).encode()
    assert bpe.TreeBPE(RANKS, PATTERN, leaf_bytes=1).encode_piece(piece).tolist() == encoding()._core_bpe.encode_single_piece(piece)


def test_bpe_tables(docs, empty):
    out = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN)
    assert out.columns == [*docs.columns, "ids", "decoded"]
    for row in out.collect():
        assert row["ids"] == encoding().encode_ordinary(row["text"] or "")
        assert bytes(row["decoded"]) == (row["text"] or "").encode()
    assert bpe.decode(bpe.encode(empty, RANKS, PATTERN), RANKS, PATTERN).count() == 0
    clash = bpe.encode(docs.withColumn("ids", F.lit(1)), RANKS, PATTERN)
    assert clash.columns[-1] == "_ids"
    with pytest.raises(ValueError):
        bpe.tree(RANKS, PATTERN).decode([10**6])


# quality rules


def test_base_counts():
    assert quality_rules.base_counts(None) == (0, 0, 0, 0, 0)
    text = "a b c a b c\n#x é|\n\na b c a b c\n \n"
    words = [w for w in text.replace("\n", " ").split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    assert quality_rules.base_counts(text.encode()) == (len(words), sum(map(len, words)), 2, 1, len(marked))


def test_kneser_ney_is_a_distribution():
    text = prose(3000).encode()
    grams, n = np.unique(quality_rules._grams(text), return_counts=True)
    model = quality_rules.kneser_ney(grams, n)
    for context in (b"th", b"zz", b"e ", b"\0\0", b"a\xff"):
        all_next = (context[0] << 16) | (context[1] << 8) | np.arange(256)
        assert abs(np.exp(model.log_probabilities(all_next)).sum() - 1) < 0.02, context


def test_kneser_ney_counts_and_scores(docs):
    counts = {(r["lang"], r["gram"]): r["n"] for r in quality_rules.count_grams(docs).collect()}
    expect = Counter()
    for d, t in TEXTS:
        for g in quality_rules._grams((t or "").encode()).tolist():
            expect["en" if (d or 0) % 2 else "", g] += 1
    assert counts == dict(expect)


def test_quality_rejects_noise_and_keeps_prose(spark):
    rows = [(i, "\n".join(prose(12) for _ in range(12)), "en") for i in range(200)]
    noise = ["".join(R.choice("#$%&*zqxj0123456789 ") for _ in range(1500)) for _ in range(4)]
    loop = ["storm " * 300]
    frame = spark.createDataFrame([*rows, *((1000 + i, t, "en") for i, t in enumerate(noise + loop))], "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.rules(frame).collect()}
    assert sum(kept[i] for i in range(200)) >= 195 and not any(kept[1000 + i] for i in range(5))
    assert {r["doc_id"] for r in quality_rules.kept(frame).collect()} == {d for d, k in kept.items() if k}


def test_quality_tables(docs, empty):
    out = quality_rules.rules(docs)
    rows = out.collect()
    assert len(rows) == len(TEXTS)
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (4, 5, 6, 7))
    assert quality_rules.rules(empty).count() == 0


# line dedup


def lines_brute(rows, min_chars=20, min_docs=3):
    strip = " \t\n\r\x0b\x0c"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(strip))
    owners = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= min_chars:
                owners[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if d is None or len(owners.get(key(x), ())) < min_docs or max(owners[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", ["1", "4", "23"])
def test_line_dedup(spark, docs, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = line_dedup.dedup(docs)
        got = sorted(((r["doc_id"], r["_n_lines"], r["n_dropped"], r["text"] or "") for r in out.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == lines_brute(TEXTS)
    assert out.columns == [*docs.columns, "_n_lines", "n_dropped"]


def test_line_dedup_hot_line(spark):
    rows = [(i, f"one line that every document has\nline number {i} is its own, and long enough\n{'pair line of many documents' if i % 2 else ''}") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup(frame).collect()), key=str)
    assert got == lines_brute(rows)
    assert line_dedup.dedup(frame.limit(0)).count() == 0


def test_bitmaps_unpack():
    keep = np.array([True, False, True, True, True, True, True, True, True, False])
    bits = np.ones(16, dtype=bool)
    bits[:10] = keep
    assert line_dedup.unpack(zlib.compress(np.packbits(bits).tobytes()), 12).tolist() == [*keep.tolist(), True, True]


# SimHash


def fingerprint_brute(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_brute(codes, bits=4):
    up = list(range(len(codes)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def test_fingerprints_and_components(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["fp"] % (1 << 64)) for r in got) == Counter((d, fingerprint_brute(t)) for d, t in TEXTS)
    roots = components_brute([fingerprint_brute(t) for _, t in TEXTS])
    least = {}
    for root, (d, _) in zip(roots, TEXTS):
        least[root] = min(x for x in (least.get(root), d) if x is not None) if (least.get(root), d) != (None, None) else None
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((d, least[root]) for root, (d, _) in zip(roots, TEXTS))
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("chunk", [8, 8192])
def test_links_lose_no_component(spark, chunk, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    codes = set()
    for _ in range(60):
        code = R.getrandbits(64)
        for _ in range(R.randint(1, 5)):
            codes.add(code)
            for _ in range(R.randint(1, 4)):
                code ^= 1 << R.randrange(64)
    base = R.getrandbits(64)  # a tight group, and a chain out of it
    codes |= {base ^ (1 << i) ^ (1 << j) for i in range(14) for j in range(i)}
    codes = sorted(codes)
    frame = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c, i) for i, c in enumerate(codes)], "fp long, id long")
    found = {r["a"]: r["b"] for r in components.components(simhash.links(frame)).collect()}
    assert [found.get(i, i) for i in range(len(codes))] == components_brute(codes)


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1500)] + [(7, 7)], "a long, b long")
    found = {r["a"]: r["b"] for r in components.components(links).collect()}
    assert found == {i: 0 for i in range(1, 301)} | {i: 1000 for i in range(1001, 1500)}


# ordinal classifier


def test_ordinal_separates_grades_it_has_not_seen():
    good = lambda: prose(60)
    poor = lambda: " ".join(w + "&&&" for w in prose(60).split())
    toxic = lambda: prose(30) + " scum " + prose(30)
    make = {0: toxic, 1: poor, 2: good}
    grades = np.array([R.choice([0, 1, 2, 2, 2]) for _ in range(900)])
    features = ordinal.Features()
    rows = [features(make[g]().encode()) for g in grades]
    model = ordinal.fit(rows[:600], grades[:600])
    assert model.thresholds[0] < model.thresholds[1]
    tail = 1 - model.cumulative(np.array([model.score(x) for x in rows[600:]]))[:, -1]
    assert ((tail >= 0.5) == (grades[600:] == 2)).mean() > 0.95


def test_ordinal_tables(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0), (8, 1, 1), (9, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows, grades = ordinal.labelled(docs, labels)
    assert sorted(grades.tolist()) == [0, 1, 1, 2, 2]
    out = ordinal.grades(docs, ordinal.fit(rows, grades))
    assert out.columns == [*docs.columns, "expected_grade", "tail_probability", "_kept"] and out.count() == len(TEXTS)
    none = ordinal.labelled(docs, labels.limit(0))
    assert all(r["_kept"] for r in ordinal.grades(docs, ordinal.fit(*none)).collect())
    assert ordinal.grades(empty, ordinal.fit(*none)).count() == 0


# sentence spans


def test_sentences_are_the_text():
    for _, t in TEXTS:
        assert b"".join(sentence_spans.sentences((t or "").encode())) == (t or "").encode()


def test_sentence_spans(docs, empty):
    first, covered = {}, defaultdict(set)
    for d, t in sorted((x for x in TEXTS if x[0] is not None), key=lambda x: (x[0], xxhash.xxh64_intdigest((x[1] or "").encode(), 42))):
        for h, pos, n in sentence_spans.runs(sentence_spans.sentences((t or "").encode())):
            if first.setdefault(h, (d, t, pos)) != (d, t, pos):
                covered[d, t].update(range(pos, pos + n))
    out = sentence_spans.dedup(docs)
    for r, (d, t) in zip(sorted(out.collect(), key=lambda r: (str(r["doc_id"]))), sorted(TEXTS, key=lambda x: str(x[0]))):
        parts = sentence_spans.sentences((t or "").encode())
        assert (r["text"] or "").encode() == b"".join(p for i, p in enumerate(parts) if i not in covered[d, t])
    assert out.where("doc_id IN (1)").first()["n_removed"] == 0 and out.where("doc_id = 2").first()["n_removed"] >= 6
    assert sentence_spans.dedup(empty).count() == 0


def test_a_repeated_passage_of_few_long_sentences_goes(spark):
    long = [sentence(27), sentence(26)]
    frame = spark.createDataFrame([(1, sentence() + " " + " ".join(long)), (2, " ".join(long) + " " + sentence())], "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in sentence_spans.dedup(frame).collect()}
    assert all(x in kept[1] and x not in kept[2] for x in long)


def test_a_repeated_passage_of_short_lines_or_cut_sentences_goes(spark):
    verse = "\n".join(" ".join(sentence(3)[:-1].split()) for _ in range(20))  # 60 words in lines of 3
    inner, head, tail = sentence(8) + " " + sentence(8), sentence(20)[:-1], sentence(20)[:-1]
    cut = f"{head} {sentence(3)} {inner} {tail}"
    rows = [(1, f"{sentence()}\n{verse}\n{sentence()}"), (2, f"{sentence()}\n{verse}\n{sentence()}"), (3, f"Other {cut} words."), (4, f"More {cut} end.")]
    kept = {r["doc_id"]: r["text"] for r in sentence_spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert verse in kept[1] and not any(line in kept[2] for line in verse.split("\n"))
    assert inner in kept[3] and not any(x in kept[4] for x in inner.split(". "))


# token packing


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 32])
def test_packing_round_trip(width):
    for n in (0, 1, 7, 4097):
        ids = np.array([R.getrandbits(width) for _ in range(n)], dtype=np.uint32)
        assert token_pack.unpack(token_pack.pack(ids, width), width, n).tolist() == ids.tolist()
        docs = [ids[: n // 3], ids[n // 3 :], ids[:0]]
        shard = token_pack.Shard(token_pack.build_shard([None, 5, 9], docs, width))
        assert shard.doc_ids == [None, 5, 9] and [shard.document(i).tolist() for i in range(3)] == [d.tolist() for d in docs]


def test_token_table(docs, empty):
    from tokenizers import Tokenizer

    path = VOCABULARY("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    rows = token_pack.pack_table(docs, path, end_id=2).collect()
    start, expect = 0, []
    by_id = defaultdict(list)
    for d, t in TEXTS:
        by_id[-1 if d is None else d].append(library.encode(t or "", add_special_tokens=False).ids + [2])
    for d in sorted(by_id):
        for ids in by_id[d]:
            expect.append((None if d < 0 else d, start, len(ids), np.array(ids, dtype="<u4").tobytes()))
            start += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in rows), key=lambda x: x[1]) == expect
    assert token_pack.pack_table(empty, path, end_id=2).count() == 0


def test_chunks_encode_as_the_library():
    from tokenizers import Tokenizer

    path = VOCABULARY("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = ["", None, " a\tb ", "Hello, world!! it's <|endoftext|> ok\x0bfoo\x1cbar baz ÉCOLE... naïve 123 ab1 ß İ ΑΣ. é don't &&& x&&"]
    ids, sizes = token_pack.encoder(path).encode(pa.array(texts))
    ends = np.cumsum(sizes)
    assert [ids[e - s : e].tolist() for e, s in zip(ends, sizes)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_tokens_are_those_of_the_untouched_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = VOCABULARY("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [*(t for _, t in TEXTS), "hello <|endoftext|> world", "<|startoftext|>a<|endoftext|><|endoftext|>", "<|endoftext", "x <|EndOfText|>", "Äb<|startoftext|>\nÉ ok", "end<|endoftext|>", None]
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(token_pack, "RANGE_IDS", 50)
    expect = defaultdict(list)
    for d, t in rows:
        expect[d].append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes())
    for size in (1, 100, token_pack.SHARD_BYTES):
        folder = token_pack.scratch_path(spark, "tokens")
        shards = token_pack.write(frame, path, 2, folder, special_tokens=True, shard_bytes=size)
        assert size > 1 or len(shards) == len(rows)
        got = sorted(token_pack.read(spark, shards).collect(), key=lambda r: r["start"])
        by_id = defaultdict(list)
        for r in got:
            by_id[r["doc_id"]].append(bytes(r["ids"]))
        assert {d: sorted(x) for d, x in by_id.items()} == {d: sorted(x) for d, x in expect.items()}
        assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
        assert [-1 if r["doc_id"] is None else r["doc_id"] for r in got] == sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got)


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = VOCABULARY("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [t for _, t in TEXTS if t and len(t) < 5000] + ["a  b\n c <|endoftext|>d"]
    ids, sizes = token_pack.ChunkEncoder(path, special_tokens=True).encode(pa.array(texts))
    ends = np.cumsum(sizes)
    assert [ids[e - s : e].tolist() for e, s in zip(ends, sizes)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_shards_need_a_file_system(spark, docs):
    with pytest.raises(Exception):
        token_pack.write(docs, VOCABULARY("word_bpe_49k.json"), 2, "nosuch://place/folder")


# suffix arrays


def bytes_brute(rows, n=50):
    owner = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1 if d is not None else 0):
            owner[b[i : i + n]] = min(d, owner.get(b[i : i + n], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        cut = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - n + 1 if d is not None else 0):
            if owner[b[i : i + n]] < d:
                cut[i : i + n] = True
        spans = int((np.diff(np.append(0, cut.astype(int))) == 1).sum())
        out.append((d, len(b), int(cut.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~cut].tobytes()).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup(spark, docs, empty):
    got = suffix_dedup.dedup(docs.drop("kept"))
    rows = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got.collect()), key=str)
    assert rows == bytes_brute(TEXTS)
    assert suffix_dedup.dedup(empty).columns == [c for c in docs.columns if c != "text"] + ["n_bytes", "n_removed", "n_spans", "_kept"]
    assert suffix_dedup.dedup(empty).count() == 0


def test_suffix_dedup_of_overlaps_and_periods(spark):
    stock = prose(400)
    rows = [(i, "".join(stock[(a := R.randrange(len(stock) - 90)) : a + R.randint(40, 90)] + R.choice(["|", "", "~~"]) for _ in range(4))) for i in range(60)]
    rows += [(100 + i, "Ber " * R.randint(5, 60)) for i in range(6)] + [(200, "ab" * 49 + "c"), (201, "ba" * 49)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_dedup.dedup(frame).collect()), key=str)
    assert got == bytes_brute(rows)


@pytest.mark.parametrize("flush", [3, 40, 1 << 19])
def test_suffix_dedup_of_rows_that_share_ids_and_of_a_hot_passage(spark, monkeypatch, flush):
    monkeypatch.setattr(suffix_dedup, "FLUSH", flush)
    passage = " ".join(sentence() for _ in range(9))
    rows = [(5, f"{sentence()} {passage[: R.randint(60, 400)]}{sentence(R.randint(1, 60))}") for _ in range(300)]  # some equal in any 8 bits of a hash
    rows += [(1, passage), (1, passage), (2, f"{passage} {passage}"), (7, sentence(3))] + [(R.randint(10, 40), f"{sentence()} {passage}") for _ in range(60)]
    rows += [(100, "zero\0" * 30), (101, "zero\0" * 25 + "\0\0")]
    R.shuffle(rows)
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got), key=str) == bytes_brute(rows)


def test_windows_are_found_by_binary_search():
    rows = np.unique(np.array([[R.randrange(4) for _ in range(suffix_dedup._KEY_WORDS)] for _ in range(300)], dtype=np.uint64), axis=0)
    wanted = np.concatenate([rows[::3], np.array([[R.randrange(5) for _ in range(suffix_dedup._KEY_WORDS)] for _ in range(300)], dtype=np.uint64)])
    at, found = suffix_dedup._search(rows, wanted)
    plain = [tuple(x) for x in rows.tolist()]
    for w, i, f in zip(wanted.tolist(), at.tolist(), found.tolist()):
        assert i == sum(x < tuple(w) for x in plain) and f == (tuple(w) in plain)


def test_suffix_arrays():
    for text in (b"", b"a", b"banana" * 9, bytes(R.choice(b"ab") for _ in range(300))):
        a = np.frombuffer(text, dtype=np.uint8)
        order, ranks = suffix_dedup.suffix_ranks(a)
        cut = [text[i : i + 50] for i in order]
        assert cut == sorted(cut)
        common = [0] + [next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y))) for x, y in zip(cut, cut[1:])]
        assert suffix_dedup.common_prefixes(order, ranks).tolist() == common[: len(order)]


def test_shards_are_merged():
    pieces = [prose(12)[:84].encode() for _ in range(40)]
    pieces += [p[:70] for p in pieces[:20]] + [b"x" + p[:60] for p in pieces[5:25]]
    docs = np.arange(len(pieces)) % 23
    assert sorted(suffix_dedup.settle(pieces, docs, shard_bytes=400)) == sorted(suffix_dedup.settle(pieces, docs))


# decontamination


def test_decontamination(spark, empty):
    vocabulary = ["".join(R.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    item = lambda n: [R.choice(vocabulary) for _ in range(n)]
    items = [item(30), item(40), item(7), item(2), item(14)]
    swapped = list(items[1])
    for i in (4, 15, 22, 33):
        swapped[i] = "other"
    pad = lambda: [R.choice(vocabulary) for _ in range(50)]
    rows = [
        (1, " ".join(pad() + items[0] + pad())),
        (2, " ".join(pad() + swapped + pad()).upper()),
        (3, " ".join(pad() + items[2] + pad())),
        (4, " ".join(pad() + items[3] + pad())),
        (5, " ".join(pad())),
        (6, " ".join(items[4][3:] + pad())),
        (7, None),
        (8, ""),
        (9, " ".join(pad() + items[0][:8] + pad())),
        (1, " ".join(pad() + items[0] + pad())),
        (None, " ".join(items[0])),
        (11, " ".join(pad() + items[0][:20]) + ", " + " ".join(items[1][:20])),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    expect = {(1, 0), (2, 1), (3, 2), (11, 0), (11, 1)}
    for most in (decontaminate.BROADCAST_SEEDS, 3):  # the second: beyond what is broadcast
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(frame, benchmark, broadcast_seeds=most).collect()} == expect
    assert [r["doc_id"] for r in decontaminate.clean(frame, benchmark).orderBy("doc_id").collect()] == [None, 4, 5, 6, 7, 8, 9]
    assert decontaminate.overlaps(frame.limit(0), benchmark).count() == 0 == decontaminate.overlaps(frame, benchmark.limit(0)).count()


def test_decontamination_of_short_items_misses_no_substitution(spark):
    rows, items, expect = [], [], set()
    for n in range(4, 14):
        item = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        for one in range(n):
            for other in range(one, n + 1):  # n: none
                words = ["other" if i in (one, other) else w for i, w in enumerate(item)] if other < n else item
                agree = sum(a == b for a, b in zip(words, item))
                rows.append((len(rows), "before it " + " ".join(words) + " after it"))
                if agree >= (n if n < 10 else -(-8 * n // 10)):
                    expect.add((rows[-1][0], n, agree))
    frame, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (decontaminate.BROADCAST_SEEDS, 3):
        assert {(r["doc_id"], r["item_id"], r["n_matched"]) for r in decontaminate.overlaps(frame, benchmark, broadcast_seeds=most).collect()} == expect


def test_decontamination_runs_no_python(spark, docs):
    benchmark = spark.createDataFrame([(1, prose(30))], "item_id long, text string")
    plan = decontaminate.overlaps(docs, benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href="/">Site</a><h2>My site</h2></header><nav><ul><li><a href=a>one</a><li><a href=b>two</a></ul></nav>
<div id="cookie-notice">We use cookies on this site, as all others do.</div><main><article><h1>Storms &amp; rivers</h1>
<p>The quiet   river<br>rose <b>over</b>night, &#8220;fast&#8221;.<p>Short one.<ul><li>amber<li>maple</ul>
<aside>See also: other storms</aside><div class="ad-box">Buy a lantern today, at half the price of yesterday!</div><p>1 < 2, they said.</p></article>
<section id="comments"><p>I liked this article about the river very much, thank you for it.</p></section></main>
<form><label>Mail</label><input><button>Go</button></form><footer>&copy; 2020</footer></body></html>"""


def test_main_text():
    assert html_mincut.main_text(PAGE) == "Storms & rivers The quiet river rose overnight, “fast”. Short one. amber maple 1 < 2, they said."
    assert html_mincut.main_text(None) == html_mincut.main_text("") == html_mincut.main_text("<nav><a>x</a></nav>") == ""
    html_mincut.main_text("<" * 1000 + "<p" * 100 + "</" + "<!--")


@pytest.mark.parametrize("before", ['<svg-icon name="x"></svg-icon>', "<template-part></template-part>", "<object-viewer>", "<style-guide/>", "<object>", "<canvas>", "<math>", "<svg>", "<iframe>", "<noscript>"])
def test_main_text_after_embedded_elements(before):
    said = "The quiet river rose overnight, and the storm took the lantern with it."
    assert html_mincut.main_text(f"<body><article>{before}<p>{said}</p></article></body>") == said


def test_main_text_holds_formulas_and_fallbacks_but_no_code():
    page = "<article><p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> the river <object data=a>map of it</object> rose.</p><script>var a;</script><style >p{}</style><template><p>No.</p></template></article>"
    assert html_mincut.main_text(page) == "Where x=2 the river map of it rose."


def test_main_text_without_semantic_elements():
    page = '<div class="menu"><a href=1>Home</a> <a href=2>News</a></div><div>' + "".join(f"<p>{sentence(25)}</p>" for _ in range(4)) + '</div><div class="footer">Imprint</div>'
    text = html_mincut.main_text(page)
    assert "Home" not in text and "Imprint" not in text and text.count(".") == 4


@pytest.mark.parametrize("page", ["<p" * 500_000, "<script " * 100_000, '<a "' * 250_000, "<" * 300_000, "</" * 300_000, "<!--" * 200_000, "<div>x" * 100_000, "<b>" * 50_000 + "</i>" * 50_000, '<a x="' + '<b y=">"' * 50_000])
def test_long_broken_pages_take_seconds(page):
    import time

    began = time.perf_counter()
    html_mincut.main_text(page)
    assert time.perf_counter() - began < 30


def test_neighbours_decide_where_names_say_nothing():
    menu = "".join(f"<div><a href=/{w}>{w}</a></div>" for w in WORDS[:8])
    story = [sentence(25), sentence(30), "Silence", sentence(2), sentence(28), sentence(40)]
    page = f"<body><div class=x1>{menu}</div><div class=x2><div>Only today</div></div><div class=x3>{''.join(f'<div>{x}</div>' for x in story)}</div><div class=x4><div><a href=i>Imprint</a></div><div>2020</div></div></body>"
    found = html_mincut.blocks(page)
    odds = [html_mincut.log_odds(b) for b in found]
    labels = html_mincut.min_cut(odds, html_mincut.smoothness(found))
    assert html_mincut.main_text(page) == " ".join(story)
    assert any((o > 0) != x for o, x in zip(odds, labels))  # the cut went against a block's own odds


def test_labels_of_small_pages_are_of_least_cost():
    from itertools import product

    kinds = ["<p>{}</p>", "<div class=a>{}</div>", "<li><a href=x>{}</a></li>", "<h2>{}</h2>", "<div class=ad>{}</div>", "<aside>{}</aside>", "{}<br>"]
    for _ in range(60):
        page = "".join(R.choice(["<div>", "</div>", "<article>", "</article>", "", ""]) + R.choice(kinds).format(sentence(R.choice([1, 2, 8, 30]))) for _ in range(R.randint(1, 9)))
        found = html_mincut.blocks(page)
        odds, edges = [html_mincut.log_odds(b) for b in found], html_mincut.smoothness(found)
        cost = lambda labels: sum(abs(o) for o, x in zip(odds, labels) if (o > 0) != x) + sum(w for (i, j), w in edges.items() if labels[i] != labels[j])
        best = min(product([False, True], repeat=len(found)), key=cost)
        labels = html_mincut.min_cut(odds, edges)
        assert abs(cost(labels) - cost(best)) < 1e-9
        assert html_mincut.main_text(page) == " ".join(b.text for b, x in zip(found, labels) if x)


def test_cut_is_minimal():
    from itertools import product

    for _ in range(60):
        n = R.randint(1, 8)
        odds = [R.uniform(-3, 3) for _ in range(n)]
        edges = {(i, j): R.uniform(0, 2) for i in range(n) for j in range(i) if R.random() < 0.5}
        cost = lambda labels: sum(abs(o) for o, x in zip(odds, labels) if (o > 0) != x) + sum(w for (i, j), w in edges.items() if labels[i] != labels[j])
        best = min(cost(x) for x in product([False, True], repeat=n))
        assert abs(cost(html_mincut.min_cut(odds, edges)) - best) < 1e-9


def test_html_tables(spark):
    frame = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, "y"), (2, "v", "", "z"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    out = html_mincut.extract(frame)
    assert out.columns == ["page_id", "url", "text", "_text", "n_chars"]
    assert sorted(len(r["_text"]) for r in out.collect()) == sorted(r["n_chars"] for r in out.collect())
    assert html_mincut.extract(frame.limit(0)).count() == 0


# words against the counts of plain dictionaries


def test_word_scores_are_those_of_plain_counts(spark, monkeypatch):
    r = random.Random(8)
    vocabulary = [*VOCAB[:30], "é", "日本", "A1", "x"]
    texts = [(i, " ".join(r.choice(vocabulary) + r.choice(["", ".", ",", "\n"]) for _ in range(r.randint(0, 90))), r.choice(["en", "de"])) for i in range(60)]
    texts += [(100, "the " * 400, "en"), (101, "the " * 400, "en"), (102, None, "en"), (103, "", None), (104, "--- ***", "de"), (105, " ".join(r.choice(VOCAB) for _ in range(3000)), "en")]
    frame = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(3)
    monkeypatch.setattr(word_model, "CHUNK_TOKENS", 500)
    monkeypatch.setattr(word_model, "SEGMENT", 300)
    models, frequent, n_words = quality_rules._surveyed(frame, "text", "lang")
    spelling = spark.sparkContext.broadcast(quality_rules.Spelling(models))
    docs = frame.select(F.coalesce("lang", F.lit("")).alias("lang"), "text", F.xxhash64("text").alias("doc"))
    got = {(x["lang"], x["doc"]): x["word_score"] for x in word_model.word_scores(docs, n_words, frequent, spelling, quality_rules._discounts_of).collect()}

    rows = [(x["lang"], x["text"] or "", x["doc"]) for x in docs.collect()]
    tokens = [(lang, regex.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode()), doc) for lang, text, doc in rows]
    tokens = [(lang, [w.lower() for w in words], doc) for lang, words, doc in tokens]
    assert n_words == sum(len(w) for _, w, _ in tokens) and len(frequent) > 10
    counts, scores = defaultdict(Counter), {}
    for lang, words, doc in tokens:
        counts[lang, doc & 1].update(zip([b"", *words], words, strict=False))
    for lang, words, doc in tokens:
        if not words:
            continue
        d = quality_rules._discounts_of(*(max(1, sum(n == k for f in (0, 1) for n in counts[lang, f].values())) for k in (1, 2, 3, 4)))
        other, total = counts[lang, 1 - (doc & 1)], 0.0
        context = defaultdict(list)
        for (v, _), n in other.items():
            context[v].append(n)
        for v, w in zip([b"", *words], words, strict=False):
            padded = b"  " + w + b" "
            grams = np.array([padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2] for i in range(len(w) + 1)])
            value = -float(models[lang].log_probabilities(grams).astype(np.float32).sum())
            lower = np.exp(-word_model.STEP * np.clip(np.round(value / word_model.STEP), 0, 255))
            n, all_n = other[v, w], context[v]
            left = sum(d[min(k, 3)] for k in all_n)
            total += np.log((n - d[min(n, 3)] + left * lower) / sum(all_n) if all_n else lower)
        scores[lang, doc] = -total / len(words)
    assert set(got) == set(scores)
    assert all(abs(got[k] - scores[k]) < 0.02 for k in scores), [(got[k], scores[k]) for k in scores if abs(got[k] - scores[k]) >= 0.02]


@pytest.mark.parametrize("size", [0, 1, 7, 300, 5000])
def test_words_do_not_depend_on_segments(size, monkeypatch):
    column = pa.array([None, "", "a b", "x" * size + " y", "é日" * size, "end", "Begin. " * size][::-1])
    whole = word_model.words(*word_model.raw_texts(column), np.ones(7, dtype=np.uint64))
    monkeypatch.setattr(word_model, "SEGMENT", 50)
    cut = word_model.words(*word_model.raw_texts(column), np.ones(7, dtype=np.uint64))
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))
    sliced = word_model.words(*word_model.raw_texts(column.slice(1, 4)), np.ones(4, dtype=np.uint64))
    assert sliced[0].tolist() == [w for w, row in zip(*whole[:2], strict=True) if 1 <= row < 5]


# word order


def test_quality_rejects_words_in_no_order(spark):
    r = random.Random(3)
    follow = {w: r.sample(VOCAB, 5) for w in VOCAB}

    def chain(n):
        out = [r.choice(VOCAB)]
        while len(out) < n:
            out.append(r.choice(follow[out[-1]]))
        return out

    rows = [(i, " ".join(chain(120)), "en") for i in range(200)]
    for i in range(5):
        words = chain(120)
        r.shuffle(words)
        rows.append((1000 + i, " ".join(words), "en"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = quality_rules.rules(frame).collect()
    kept = {x["doc_id"]: x["kept"] for x in found}
    assert not any(kept[1000 + i] for i in range(5)) and sum(kept[i] for i in range(200)) >= 195
    assert {x["doc_id"] for x in quality_rules.kept(frame).collect()} == {d for d, k in kept.items() if k}


VOCAB = [a + b for a in ("sto", "lan", "qui", "riv", "map", "cop", "vio", "hol", "amb", "thr") for b in ("rm", "tern", "et", "er", "le", "per", "let", "low", "ead", "ing")]


# substring dedup in little memory (last, as all tests draw from one source of random numbers)


@pytest.mark.parametrize("merged", [1, 30, 1 << 18])
def test_shards_are_merged_by_ranges(monkeypatch, merged):
    monkeypatch.setattr(suffix_dedup, "MERGED", merged)
    pieces = [prose(12)[: R.randint(50, 84)].encode() for _ in range(60)]
    pieces += [p[:55] + b"y" * R.randint(0, 20) for p in pieces[:40]] + [b"x" + p[:60] for p in pieces[5:25]] + [b"z" * 70] * 9
    docs = np.array([R.randrange(30) for _ in pieces])
    least = {}
    for p, d in zip(pieces, docs.tolist()):
        for i in range(len(p) - 49):
            least[p[i : i + 50]] = min(d, least.get(p[i : i + 50], d))
    expect = [(k, i) for k, p in enumerate(pieces) for i in range(len(p) - 49) if docs[k] > least[p[i : i + 50]]]
    for size in (60, 400, 1 << 20):
        assert sorted(suffix_dedup.settle(pieces, docs, shard_bytes=size)) == expect


def test_suffix_arrays_of_a_frequent_anchor_take_little_memory():
    anchor = b"the anchor of 16"
    source = np.random.default_rng(3)
    pieces = [anchor + source.bytes(34 + i % 9) for i in range(50_000)]  # 2.7 MB, in one task
    pieces += [p[:50] for p in pieces[:20]]
    tracemalloc.start()
    try:
        got = suffix_dedup.settle(pieces, np.arange(len(pieces)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(got) == [(50_000 + i, 0) for i in range(20)]
    assert peak < 150 << 20


def test_runs_of_a_task_take_little_memory():
    """Blocks of four million rows, as of a task that gets much of the input: none of them is a copy of another but the last ones."""
    n, blocks = 1 << 18, 16
    table = np.zeros(n, dtype=suffix_dedup._ROW)
    source = np.random.default_rng(4)

    def batches():
        for k in range(blocks):
            table["a"] = source.integers(0, 1 << 40, size=n, dtype=np.uint64) << np.uint64(24)
            table["c"], table["doc"], table["at"] = source.integers(0, 1 << 63, size=n), k, np.arange(n) << 6 | 1
            if k == blocks - 1:
                table["a"][:5], table["c"][:5] = 7 << 24, 9
                table["doc"][:5] = [1, 2, 3, 4, 4]
            block = b"".join(table[c].tobytes() for c in suffix_dedup._ROW.names)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([False]), pa.array([block], pa.binary())], ["part", "done", "block"])

    tracemalloc.start()
    try:
        got = [row for batch in suffix_dedup._met(batches()) for row in batch.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted((r["doc"], r["a"], r["whole"]) for r in got) == [(2, 7, True), (3, 7, True), (4, 7, True), (4, 7, True)]
    assert peak < 300 << 20


@pytest.mark.parametrize("few", [1, 300])
def test_suffix_dedup_by_files_and_small_shards(spark, monkeypatch, few):
    monkeypatch.setattr(suffix_dedup, "HELD", few)
    monkeypatch.setattr(suffix_dedup, "SHARD", 60 * few)
    stock = prose(300)
    rows = [(i, "".join(stock[(a := R.randrange(len(stock) - 90)) : a + R.randint(40, 90)] + R.choice(["|", "", "~~"]) for _ in range(4))) for i in range(80)]
    rows += [(100 + i, f"{sentence()} {stock[:200]} {sentence()}") for i in range(40)]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got), key=str) == bytes_brute(rows)
