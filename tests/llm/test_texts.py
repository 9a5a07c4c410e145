"""Token sizes, splitting, mixing and leakage: round trips, brute force and planted cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitegrid.llm import leakage, mixing, splitting
from sitegrid.llm.tokens import VOCABULARY, Tokenizer, token_sizes

WORDS = "rapat anggota tahunan koperasi menimbang harga gabah kering karena gudang belum dibuka dan listrik padam sejak pagi the survey team weighed plot boundary marks".split()


@pytest.fixture(scope="module")
def tokenizer():
    try:
        with open(VOCABULARY, "rb") as f:
            return Tokenizer(f.read())
    except FileNotFoundError:
        pytest.skip("no vocabulary")


def prose(rng, words, stop=True):
    out = []
    for i in range(words):
        out.append(rng.choice(WORDS) + (rng.choice([".", ".\n\n", "!", ""]) if stop and i % 9 == 8 else ""))
    return " ".join(out)


def test_sizes(spark, tokenizer):
    df = spark.createDataFrame([(1, "hello world", "a"), (2, "", "a"), (3, None, None), (4, "<|endoftext|>", "b"), (5, "é" * 500_000, "b")], "id long, text string, n_tokens string")
    got = {r["id"]: r["n_tokens"] for r in token_sizes(df.drop("n_tokens"), "text", ["id"]).collect()}
    assert got[2] == got[3] == 0 and got[1] == len(tokenizer.encode("hello world")) and got[4] > 1
    assert got[5] == len(tokenizer.encode("é" * 500_000))
    assert token_sizes(df.drop("n_tokens").limit(0), "text", ["id"]).count() == 0


def greedy(tokenizer, text, limit, overlap):
    """The walk from cut to cut, one after the other."""
    ids = np.array(tokenizer.encode(text))
    _, *levels = splitting._places(ids, text.encode(), tokenizer.bytes_of)
    char = levels[-1]
    n, cut, out = len(ids), 0, []
    while cut < n:
        start = 0 if cut == 0 else max(p for p in range(cut - overlap + 1) if char[p])
        reach = min(start + limit, n)
        end = n if reach == n else -1
        for marks in levels:
            if end <= max(cut, overlap, start + int(limit * splitting.LEAST_FILL) - 1):
                end = max(p for p in range(reach + 1) if marks[p])
        out.append((start, end))
        cut = end
    return out


@pytest.mark.parametrize("limit,overlap", [(50, 10), (64, 0), (200, 99)])
def test_pieces_equal_the_walk_and_give_the_text_again(tokenizer, limit, overlap):
    rng = random.Random(limit)
    texts = [prose(rng, 600), prose(rng, 300, stop=False), "x" * 5000, "字符" * 700, "🙂é " * 300, " " * 3000, "a\r\nb\n" * 400, prose(rng, 5), "", "0f3a" * 900, "satu, dua; " + "kata " * 30 + "tiga, empat lima " * 200]
    seen = {}
    for found in splitting.split_texts(list(enumerate(texts)), tokenizer, limit, overlap):
        for row, s, e, (data, a, b), cs, ce, no in zip(found["row"], found["start_token"], found["end_token"], found["bytes"], found["start_char"], found["end_char"], found["piece_no"], strict=True):
            assert e - s <= limit and texts[row][cs:ce] == data[a:b].decode()
            seen.setdefault(int(row), []).append((int(no), int(s), int(e), int(cs), int(ce)))
    for i, text in enumerate(texts):
        if len(tokenizer.encode(text)) <= limit:
            assert i not in seen
            continue
        pieces = sorted(seen[i])
        assert [(s, e) for _, s, e, _, _ in pieces] == greedy(tokenizer, text, limit, overlap)
        shared = [a[2] - b[1] for a, b in zip(pieces, pieces[1:], strict=False)]
        assert all(overlap <= x <= overlap + 4 for x in shared)
        again, at = "", 0
        for _, _, _, cs, ce in pieces:
            again, at = again + text[at:ce], ce
        assert again == text and pieces[0][3] == 0


def test_pieces_end_at_the_most_natural_place_and_none_is_small(tokenizer):
    rng = random.Random(3)
    sentence = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."
    paragraphs = "\r\n\r\n".join(" ".join(sentence(12) for _ in range(4)) for _ in range(60))
    wrapped = "\n".join(" ".join(sentence(9) for _ in range(3)).replace(". ", ".\n", 1) for _ in range(80))
    rows = "\n".join("| kab. lodawe | 12 | padi |" for _ in range(400))
    far = sentence(20) + "\n\n" + "kata " * 3000
    kinds = {}
    for found in splitting.split_texts(list(enumerate([paragraphs, wrapped, rows, far])), tokenizer, 300, 40):
        for row, n, kind, no, of in zip(found["row"], found["n_tokens"], found["cut_at"], found["piece_no"], found["n_pieces"], strict=True):
            assert n <= 300 and (n >= 150 or no == of - 1)
            kinds.setdefault(int(row), set()).add(kind)
    assert kinds == {0: {"paragraph", "end"}, 1: {"sentence", "end"}, 2: {"line", "end"}, 3: {"word", "end"}}
    data = b"Kab. Lodawe no. 5\r\nabc def.\n \nnext one! end"
    ids = np.arange(len(data))
    offset, paragraph, ends, line, *_ = splitting._places(ids, data, np.ones(len(data), int))
    assert np.flatnonzero(paragraph)[1:].tolist() == [data.index(b"next")] and np.flatnonzero(ends)[1:].tolist() == [data.index(b".\n") + 1, data.index(b" end")]
    assert np.flatnonzero(line)[1:].tolist() == [data.index(b"abc"), data.index(b"next")]
    _, _, ends, *_ = splitting._places(ids, data, np.ones(len(data), int), ())
    assert data.index(b" Lodawe") in np.flatnonzero(ends)


def test_split_of_a_table(spark, tokenizer):
    rng = random.Random(9)
    rows = [(1, prose(rng, 3000), "x"), (2, "short", "x"), (3, None, "x"), (4, "", "x"), (1, prose(rng, 3000), "x")]
    df = spark.createDataFrame(rows, "id long, text string, piece string")
    got = splitting.split_oversized(df, "id", "text")
    assert {r["id"] for r in got.select("id").distinct().collect()} == {1}
    assert got.where("n_tokens > 1000").count() == 0 and got.where("piece_no = 0").count() == 2
    assert splitting.split_oversized(df.limit(0), "id", "text").count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(df, "id", "text", 100, 60)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=5), st.integers(1, 40), st.integers(0, 5))
def test_quotas_are_exact(blocks, shards, seed):
    quotas = mixing.split_quotas(blocks, shards, seed)
    assert quotas.sum(0).tolist() == blocks and (quotas >= 0).all()
    sizes = quotas.sum(1)
    assert sizes.max() - sizes.min() <= np.ceil(np.log2(shards)) + 1


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_mix_meets_shares_and_caps(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a"] * 6 + ["b"] * 2 + ["c", "other", None]), rng.choice([0, None, 5, 40, 300])) for i in range(4000)]
    sizes = spark.createDataFrame(rows, "id long, source string, n_tokens long").cache()
    goals = targets(spark, [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 4), ("d", 0.4, 2), (None, 0.1, 1)])
    mix = mixing.mix_sources(sizes, goals, "id", shard_tokens=20_000, block_tokens=500).cache()
    got = mix.toPandas()
    assert not got.duplicated(["id", "copy"]).any()
    uses = got.groupby(["source", "id"]).size().groupby("source").max()
    assert uses["a"] <= 1 and uses["b"] <= 3 and uses["c"] <= 4 and set(uses.index) == {"a", "b", "c"}
    share = got.groupby("source").n_tokens.sum() / got.n_tokens.sum()
    assert abs(share["a"] - 0.5) < 0.005 and abs(share["b"] - 0.3) < 0.005 and abs(share["c"] - 0.2) < 0.005
    for _, g in got.groupby("shard"):
        assert sorted(g.position) == list(range(len(g)))
    again = mixing.mix_sources(sizes.repartition(7), goals, "id", shard_tokens=20_000, block_tokens=500).toPandas()
    order = ["id", "copy"]
    assert got.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))
    report = {r["source"]: r for r in mixing.mix_report(mix, goals, "id").collect()}
    assert report["d"]["n_rows"] == 0 and abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9


@pytest.mark.parametrize("shards", [1, 2, 3, 7, 40, 257])
def test_subtrees_of_tasks_make_the_whole_tree(shards):
    blocks = [300, 0, 41, 7]
    whole = mixing.split_quotas(blocks, shards, 3)
    for depth in (0, 1, 3):
        parts = [x for n in range(1 << depth) for x in mixing.subtree_quotas(blocks, shards, 3, [n >> k & 1 for k in reversed(range(depth))])]
        assert sorted(p[0] for p in parts) == list(range(shards))
        for shard, have, before in parts:
            assert have.tolist() == whole[shard].tolist() and before.tolist() == whole[:shard].sum(0).tolist()


def test_draws_from_more_blocks_than_the_library_takes():
    have, rng = np.array([2_000_000_000, 5, 3_000_000_000, 0], np.int64), np.random.default_rng(1)
    got = mixing._drawn(have, 2_500_000_000, rng)
    assert got.sum() == 2_500_000_000 and (got >= 0).all() and (got <= have).all() and abs(got[0] - 1_000_000_000) < 200_000
    assert mixing.split_quotas(have.tolist(), 3, 1).sum(0).tolist() == have.tolist()


def test_mix_fills_quotas_past_oversized_rows_and_spreads_copies(spark):
    rows = [(i, "a", 50 + i % 7) for i in range(2000)] + [(5000 + i, "b", 9000 if i % 40 == 0 else 60) for i in range(800)] + [(9999, "a", 100)] * 1000
    sizes = spark.createDataFrame(rows, "id long, source string, n_tokens long")
    goals = targets(spark, [("a", 0.75, 1), ("b", 0.25, 1)])
    mix = mixing.mix_sources(sizes, goals, "id", total=80_000, shard_tokens=5_000, block_tokens=200).cache()
    tokens = {r["source"]: r["t"] for r in mix.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    assert 59_900 <= tokens["a"] <= 60_000 and 19_930 <= tokens["b"] <= 20_000
    got = mix.toPandas()
    for i, g in got[got.id != 9999].groupby("id"):
        assert len(g) == 1
    assert 100 < (got.id == 9999).sum() <= 1000
    sizes_of = got.groupby("shard").n_tokens.sum()
    assert len(sizes_of) == 16 and sizes_of.sum() == sum(tokens.values())


def test_mix_has_no_most_shards_or_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SUBTREE_SHARDS", 4)
    rows = [(i, f"s{i % 60}", 10) for i in range(6000)]
    mix = mixing.mix_sources(spark.createDataFrame(rows, "id long, source string, n_tokens long"), targets(spark, [(f"s{i}", 1 / 60, 1) for i in range(60)]), "id", shard_tokens=500, block_tokens=20).cache()
    assert mix.count() == 6000 and mix.select("id").distinct().count() == 6000
    per = [r["t"] for r in mix.groupBy("shard").agg(F.sum("n_tokens").alias("t")).collect()]
    assert len(per) == 120 and max(per) - min(per) <= 20 * 8


def test_mix_of_nothing_and_of_a_given_total(spark):
    sizes = spark.createDataFrame([(i, "a", 10) for i in range(100)] + [(1000 + i, "b", 10) for i in range(100)], "id long, source string, n_tokens long")
    assert mixing.mix_sources(sizes, targets(spark, []), "id").count() == 0
    assert mixing.mix_sources(sizes.limit(0), targets(spark, [("a", 1.0, 1)]), "id").count() == 0
    part = mixing.mix_sources(sizes, targets(spark, [("a", 0.5, 1), ("b", 0.5, 1)]), "id", total=400)
    assert {r["source"]: r["count"] for r in part.groupBy("source").count().collect()} == {"a": 20, "b": 20}


ITEMS = [
    (1, "Read the passage and answer briefly. The barefoot clove broker of the lower ward sealed two chests of dried cloves under dispute, yet the final measure came out odd. Halfway through the rowing contest the exiled vanilla grower engraved nine bundles of purple matting. Which statement is false about Setateru?"),
    (2, "Read the passage and answer briefly. Menjelang pergantian juru kunci, penenun dari kampung atas menggadaikan selembar wesel tanpa tanggal setinggi lutut; asalkan bunga dibayar di muka. Peternak itik keliling kabarnya memindahkan guci berisi koin yang belum dibayar kepada keponakan sulung. Berapa sisa yang menjadi hak Nadilecih?"),
    (3, ""), (4, None), (5, "abc"),
]


def found(texts, items=None):
    return {(n, i) for n, i, _ in leakage.leaks_in(texts, indexed(items or ITEMS))}


def indexed(items):
    rows = [(i, t) for i, t in items if t is not None]
    shared = leakage.shared_openings([t for _, t in rows])
    return leakage.index_items([(i, t, leakage.own_start(t, leakage.stream(leakage._opening(t)).tobytes() in shared)) for i, t in rows])


def letters(rng, n):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def spaced(rng, text):
    """The letters as words of 3 to 8."""
    out, at = [], 0
    while at < len(text):
        n = rng.randrange(3, 9)
        out.append(text[at : at + n])
        at += n
    return " ".join(out)


def every(text, n, change):
    return "".join(change(c) if i % n == n - 1 else c for i, c in enumerate(text))


def without_filter(text, items):
    """Items found by aligning every band of diagonals of every item, whatever grams it shares."""
    out, codes = set(), leakage.stream(text)
    for x, number in enumerate(items.ids):
        whole = items.codes[x]
        covered = np.zeros(len(whole), bool)
        for low in range(-(len(whole) // leakage.BAND + 1) * leakage.BAND, len(codes), leakage.BAND):
            shift = max(len(c) for c in items.codes)
            low -= (low + shift) % leakage.BAND  # bands start where those of the operator do
            part = slice(items.own[x], None)
            m = leakage._align([(whole[part], codes, low + items.own[x], low + items.own[x] + 2 * leakage.BAND - 1)])[0]
            covered[part] |= leakage._in_runs(m, int(items.least[x]))
        if items.share(x, covered) >= leakage.LEAST_SHARE:
            out.add(number)
    return out


def test_planted_leaks():
    rng = random.Random(1)
    body = ITEMS[0][1].split(". ", 1)[1]
    pad = lambda n=60: prose(rng, n)
    hidden = "".join(c + ("­" if i % 11 == 0 else "​" if i % 17 == 0 else "") for i, c in enumerate(body))
    words = body.split()
    changed = " ".join("lain" if i % 8 == 3 else w for i, w in enumerate(words))
    inserted = " ".join(w + (" pula" if i % 7 == 2 else "") for i, w in enumerate(words))
    sentences = body.split(". ")
    texts = [
        f"{pad()} {body} {pad()}", body.upper().replace(" ", "\n"), f"{pad()} {hidden}", f"{pad()} {changed} {pad()}", inserted, " ".join(words[: int(len(words) * 0.62)]) + " " + pad(), f"{sentences[1]}. {pad(20)} {sentences[0]}.",
        "".join(c for c in body.lower() if c.isalpha() or c == " "), f"{pad(4000)} {body} {pad(4000)}",
    ]
    assert found(texts) == {(n, 1) for n in range(len(texts))}


def test_very_long_texts_are_searched_in_windows(monkeypatch):
    monkeypatch.setattr(leakage, "TOGETHER", 3_000)
    rng = random.Random(5)
    body = ITEMS[0][1].split(". ", 1)[1]
    for words in range(0, 1400, 35):
        assert found([f"{prose(rng, words)} {body} {prose(rng, 1400 - words)}", body]) == {(0, 1), (1, 1)}


def test_unequal_stretches_in_different_windows_count_together(monkeypatch):
    rng = random.Random(8)
    words = ITEMS[0][1].split(". ", 1)[1].split()
    n = len(words)
    first, second = " ".join(words[: int(n * 0.46)]), " ".join(words[int(n * 0.9) :])
    text = f"{prose(rng, 300)} {first} {prose(rng, 6000)} {second} {prose(rng, 300)}"
    assert found([text, prose(rng, 20)]) == {(0, 1)}
    monkeypatch.setattr(leakage, "TOGETHER", 3_000)
    assert found([text, prose(rng, 20)]) == {(0, 1)}


@pytest.mark.parametrize("n", range(10, 28))
def test_a_copy_of_a_short_item_is_found(n):
    rng = random.Random(n)
    item = letters(rng, n)
    assert found([f"{prose(rng, 300)} {item} {prose(rng, 300)}", item], [(1, item)]) == {(0, 1), (1, 1)}


@pytest.mark.parametrize(("size", "leaked"), [(12, False), (16, False), (19, True), (20, True), (24, True), (32, True)])
def test_fragments_count_from_the_stated_length_on(size, leaked):
    for seed in range(10):
        rng = random.Random(seed)
        item = letters(rng, 240)
        text = " ".join(f"{item[a : a + size]} {letters(rng, 90)}" for a in range(0, 240, size))
        assert found([text], [(1, " ".join(item[a : a + size] for a in range(0, 240, size)))]) == ({(0, 1)} if leaked else set())


@pytest.mark.parametrize("apart", [15, 20])
def test_a_letter_changed_at_intervals(apart):
    for seed in range(20):
        rng = random.Random(seed)
        item = letters(rng, 48)
        assert found([f"{letters(rng, 200)} {every(item, apart, lambda c: '9')} {letters(rng, 200)}"], [(1, spaced(rng, item))]) == {(0, 1)}


def test_nothing_is_lost_against_alignment_without_a_filter():
    """Made cases of 10 to 600 letters, changed in many ways: the same verdict as without any filter in 99 of 100 cases."""
    agree = cases = both = 0
    for seed in range(160):
        rng = random.Random(seed)
        item = letters(rng, rng.choice([10, 14, 20, 30, 48, 80, 150, 300, 600]))
        items = indexed([(1, spaced(rng, item))])
        apart, size = rng.randrange(11, 40), rng.randrange(10, 60)
        text = rng.choice([
            item, item[: int(len(item) * rng.uniform(0.4, 0.7))], every(item, apart, lambda c: "9"), every(item, apart, lambda c: c + "9"), every(item, apart, lambda c: ""),
            " ".join(item[a : a + size] + letters(rng, rng.choice([5, 40, 90])) for a in range(0, len(item), size)), every(item, apart, lambda c: c + letters(rng, rng.randrange(1, 60))),
        ])
        text = letters(rng, rng.randrange(0, 200)) + text + letters(rng, rng.randrange(0, 200))
        plain, got = bool(without_filter(text, items)), bool(leakage.leaks_in([text], items))
        cases, agree, both = cases + 1, agree + (plain == got), both + plain
    assert agree >= 0.99 * cases and 0.2 * cases < both < 0.9 * cases


def test_no_leaks():
    rng = random.Random(2)
    body = ITEMS[0][1].split(". ", 1)[1].split()
    quote = " ".join(body[5:17])
    texts = [ITEMS[0][1].split(". ")[0] + ". " + prose(rng, 80), prose(rng, 50) + " " + quote, prose(rng, 3000), "", None, "x", " ".join(sorted(body)), "the barefoot vanilla grower of the upper ward engraved one chest of purple cloves, yet the measure was even"]
    assert found(texts) == set()
    assert found([ITEMS[0][1]], [(3, ""), (5, "abc")]) == set()


def test_alignment_matches_an_edit_distance_table():
    rng = random.Random(7)
    for _ in range(30):
        a = np.array([rng.randrange(4) for _ in range(30)], np.uint8)
        b = a.copy()
        for _ in range(3):
            i = rng.randrange(len(b))
            b = rng.choice([np.delete(b, i), np.insert(b, i, 9)])
        b = np.concatenate([np.full(5, 8, np.uint8), b, np.full(6, 8, np.uint8)])
        matched = leakage._align([(a, b, -8, 20)])[0]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        table[:, 0] = range(len(a) + 1)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = min(table[i, j] + (a[i] != b[j]), table[i, j + 1] + 1, table[i + 1, j] + 1)
        assert matched.sum() >= len(a) - table[-1].min()


def test_leaks_of_tables(spark, folder):
    body = ITEMS[1][1]
    docs = spark.createDataFrame([(1, f"a {body} b", "x"), (2, None, "x"), (3, "", "x"), (1, f"a {body} b", "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame(ITEMS + ITEMS[:2], "item_id long, text string")
    got = leakage.leaked_items(docs.drop("item_id"), items)
    assert [tuple(r)[:2] for r in got.collect()] == [(1, 2)]
    small = leakage.leaked_items(docs.drop("item_id"), items, item_chars=50)
    assert {tuple(r)[:2] for r in small.collect()} == {(1, 2)}
    assert leakage.leaked_items(docs.drop("item_id").limit(0), items).count() == 0
    assert leakage.leaked_items(docs.drop("item_id"), items.limit(0)).columns == ["doc_id", "item_id", "share"]
    assert leakage.leaked_items(docs.drop("item_id"), items.limit(0)).count() == 0


def test_text_keys_and_many_blocks(spark):
    rng = random.Random(4)
    items = [(f"item {i}", spaced(rng, letters(rng, 120))) for i in range(12)]
    texts = [(f"doc {i}", f"{prose(rng, 40)} {items[i % 12][1]} {prose(rng, 40)}" if i % 3 else prose(rng, 60)) for i in range(60)]
    docs, asked = spark.createDataFrame(texts, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string")
    one, many = ({tuple(r)[:2] for r in leakage.leaked_items(docs, asked, item_chars=n).collect()} for n in (1_000_000, 300))
    assert one == many == {(f"doc {i}", f"item {i % 12}") for i in range(60) if i % 3}


def test_leaks_against_shared_words(spark, folder):
    """Over whole tables: the pairs are those with half of an item's runs of four words."""
    import re
    import unicodedata

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/eval_items.parquet").collect()]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    split = lambda t: re.findall(r"[^\W_]+", "".join(c for c in unicodedata.normalize("NFKD", t).lower() if not unicodedata.combining(c)))
    index, lengths = {}, {}
    for i, t in items:
        w = split(t)
        lengths[i] = len(w)
        for k in range(len(w) - 3):
            index.setdefault(tuple(w[k : k + 4]), set()).add((i, k))
    plain = set()
    for d, t in docs:
        w, covered = split(t or ""), {}
        for j in range(len(w) - 3):
            for i, k in index.get(tuple(w[j : j + 4]), ()):
                covered.setdefault(i, set()).update(range(k, k + 4))
        plain |= {(d, i) for i, c in covered.items() if len(c) >= 0.5 * lengths[i]}
    got = {(d, i) for d, i in ((docs[n][0], i) for n, i in found([t for _, t in docs], items))}
    assert plain <= got
