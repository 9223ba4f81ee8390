"""The operators against brute force, SQL, round trips and held-out labels, and on awkward rows."""
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docmill.llm import decontaminate, lines, minhash, neighbours, pieces, pii, quality, queries, sharding, spans, tokenfiles
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
WORDS = "alpha beta gamma delta one two three four five six seven eight nine ten red green blue".split()


def awkward(spark):
    """Null, empty, long and repeated rows, and a column that clashes."""
    long = " ".join(random.Random(1).choices(WORDS, k=20_000))
    rows = [
        (1, None, "en", None, None, "x"), (2, "", "en", "s", 0, "x"), (None, "a b c. d e f!\nline", "en", "s", 3, None),
        (3, long, "en", "s", 9, "x"), (3, long, "en", "s", 9, "x"), (4, "▁ \t tab  two▁ 😀\n\n", None, "s", 9, "x"), (5, "   ", "en", "s", 3, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.QUERIES.items() if sql])
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, *queries.QUERIES[name]) is None


def test_shards_fill_the_table(spark):
    table = sharding.lookup_table(sharding.named_shards(spark, 7), 101).collect()
    assert sorted(r.slot for r in table) == list(range(101))
    counts = [sum(r.shard == s for r in table) for s in {r.shard for r in table}]
    assert len(counts) == 7 and max(counts) - min(counts) <= 1
    fewer = {r.slot: r.shard for r in sharding.lookup_table(sharding.named_shards(spark, 6), 101).collect()}
    stayed = sum(fewer[r.slot] == r.shard for r in table if r.shard != "shard-6")
    assert stayed > 60
    rows = awkward(spark)
    placed = sharding.place(rows, F.col("doc_id"), sharding.lookup_table(sharding.named_shards(spark, 7), 101), 101)
    assert placed.count() == rows.count() and placed.where("shard IS NULL").count() == 0
    assert sharding.lookup_table(sharding.named_shards(spark, 0), 101).count() == 0


def test_hit_words_equal_brute_force(spark):
    r = random.Random(4)
    items = [(str(i), [r.choice(WORDS[:5]).encode() for _ in range(r.randint(0, 14))]) for i in range(25)]
    automaton = decontaminate.SuffixAutomaton(items, 10)
    for _ in range(200):
        words = [r.choice(WORDS[:5]).encode() for _ in range(30)]
        for _ in range(2):
            _, item = r.choice(items)
            at = r.randint(0, 20)
            words[at : at + len(item)] = item
        hit, found = set(), set()
        for name, item in items:
            n = min(len(item), 10)
            for k in range(max(len(item) - 9, 1) if item else 0):
                for i in range(len(words) - n + 1):
                    if words[i : i + n] == item[k : k + n]:
                        hit |= set(range(i, i + n))
                        found.add(name)
        got, names = automaton.scan(words)
        assert {i for a, b in decontaminate.united(got) for i in range(a, b)} == hit and names == found


def test_benchmark_passages_are_cut(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    filler = " ".join(f"f{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"{filler} {passage.upper()}, {filler}"), (2, passage), (3, filler), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([("a", passage), (None, "z z"), ("b", None), ("c", "")], "item_id string, text string")
    for block in (1, 50_000):
        got = {r[0]: r[1] for r in decontaminate.without_spans(docs, items, block_words=block).collect()}
        assert got == {1: f"{filler} , {filler}", 3: filler, 4: None}
    assert decontaminate.matches(awkward(spark), items).count() == 7
    assert decontaminate.matches(docs, items.limit(0)).where("size(items) > 0").count() == 0


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = awkward(spark)
    for part, rows in enumerate((docs, docs.limit(0))):
        folder = f"{tmp_path}/{part}"
        path = public_tokenizers.path("word_bpe_49k.json")
        tokenfiles.write(rows, folder, path, 1)
        store = tokenfiles.TokenStore(spark, folder)
        got = store.documents().orderBy("ordinal").collect()
        assert len(got) == rows.count()
        whole = Tokenizer.from_file(path)
        want = sorted(
            (r.doc_id is not None, r.doc_id or 0, zlib.crc32(np.array(whole.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()))
            for r in rows.collect()
        )
        assert sorted((r.key is not None, r.key or 0, r.crc32) for r in got) == want
        assert [r.start for r in got] == [sum(x.n_ids for x in got[:i]) for i in range(len(got))]
        found = store.found(spark.createDataFrame([(3,), (5,), (77,), (None,)], "key long")).collect()
        assert {r.key: r.copies for r in found} == ({3: 2, 5: 1, 77: 0, None: 0} if part == 0 else dict.fromkeys((3, 5, 77, None), 0))
        if part == 0:
            assert [len(x) for x in store.get(2)] == [1] and store.get(99) == [] and len(store.get(3)) == 2


def test_words_of_the_coder_equal_the_library():
    coder = tokenfiles.Coder(public_tokenizers.path("word_bpe_49k.json"), 1, 2, True)
    r = random.Random(2)
    parts = ["a", "B", "É", "é", "'s", "'LL", " ", "\n", ".", "!", "—", "…", "1", "٣", " ", "\x1c", "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "Σ", "don't", ",;", "̀"]
    for _ in range(3000):
        text = "".join(r.choices(parts, k=r.randint(0, 14)))
        assert coder.encode([text])[0] == coder._coded([text])[0] + coder.end, text


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    index = tokenfiles.Index(tokenfiles._index_bytes(keys, np.arange(len(keys)), np.ones(len(keys), np.int64)))
    first, copies = index.find(keys)
    assert (first == np.arange(len(keys))).all() and (copies == 1).all()
    assert sorted(index.hash.numbers(keys)) == list(range(len(keys)))
    assert index.find(keys + 1)[1].sum() < 3


def test_personal_data():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub("[^0-9]", "", s)
    r = random.Random(3)
    for n in range(4000):
        t = "".join(r.choices("12.+5 -@a()é" if n % 2 else "aB.@+-0129 ", k=r.randint(0, 60)))
        assert pii.plain(t) == {
            "email": [m.span() for m in email.finditer(t)],
            "ip": [m.span() for m in ip.finditer(t) if all(int(x) < 256 for x in m[0].split("."))],
            "card": [m.span() for m in card.finditer(t) if 13 <= len(digits(m[0])) <= 19 and pii._luhn(digits(m[0]))],
            "phone": [m.span() for m in phone.finditer(t) if 9 <= len(digits(m[0])) <= 15],
        }, t
    cases = {
        "to john.doe [at] example [dot] com now": "john.doe [at] example [dot] com", "john at example dot co dot uk": "john at example dot co dot uk",
        "x jоhn​@example.cоm": None, "１９２.168.0.1!": "１９２.168.0.1", "card 4111–1111–1111–1111 x": "4111–1111–1111–1111",
        "call plus four nine one five one two three four five six": "plus four nine one five one two three four five six", "192[.]168[.]0[.]1": "192[.]168[.]0[.]1",
    }
    for text, want in cases.items():
        base, every = pii.find(text)
        assert set(base) <= set(every)
        if want:
            assert [text[a:b] for _, a, b in every] == [want], text
    for clean in ("Look at one dot on two or three lines.", "at home (at) last", "", None, "a" * 200_000, "1" * 200_000, "." * 200_000):
        assert pii.find(clean) == ([], [])


def test_addresses_in_words():
    found = lambda t: [t[a:b] for _, a, b in pii.find(t)[1]]
    for last in ("pl", "se", "no", "nz", "xyz", "shop", "com"):
        assert found(f"write to jane at example dot {last}, please") == [f"jane at example dot {last}"]
    for text in ("jane at example.com", "jane\nat\texample.com", "jane@example dot com", "jane at mail dot example.pl", "j dot doe at example dot co dot nz"):
        assert found(text) == found(f"{text} - an anecdote")[:1] == [text]
    assert found("look at a dot jane at example dot com") == ["a dot jane at example dot com"]
    assert found("jane at example dot com dot then") == ["jane at example dot com"]
    for clean in ("look at the dot matrix printer", "Look at one dot on two lines", "at home. Dot by dot", "x at y.z", "jane@example dot nothing"):
        assert found(clean) == []


def test_pieces_round_trip_and_search(spark):
    model = queries.piece_model()
    r = random.Random(1)
    parts = ["a", "the", " ", "  ", ".", ",", "!?", "\n", "é", "▁", "ing", "日", "😀", "thing", "..."]
    for _ in range(1500):
        text = "".join(r.choices(parts, k=r.randint(0, 20)))
        ids = np.frombuffer(model.encode_many([text])[0], np.int32).tolist()
        assert ids == (model.search(" " + text) if text else []) and model.decode(ids) == text
    # the window against a search over the whole text
    small = pieces.Pieces([("a", -1.0, "normal"), ("ab", -1.5, "normal"), ("ba", -1.2, "normal"), ("aba", -2.0, "normal"), ("b", -1.1, "normal")], False)
    for n in (1, 7, 300):
        text = "".join(r.choices("ab", k=n))
        best = [(0.0, [])]
        for end in range(1, n + 1):
            best.append(max(((best[end - k][0] + small.score[text[end - k : end]], best[end - k][1] + [text[end - k : end]]) for k in range(min(3, end), 0, -1) if text[end - k : end] in small.score), key=lambda x: x[0]))
        assert sum(small.score[small.bytes[i].decode()] for i in small.search(text)) == pytest.approx(best[n][0])
        assert small.decode(small.search(text)) == text
    docs = awkward(spark)
    back = pieces.decode(pieces.encode(docs, model), model)
    once = pieces.round_trip(docs, model)
    assert sorted(map(str, once.collect())) == sorted(map(str, back.collect()))
    assert back.where("decoded <=> coalesce(text, '')").count() == docs.count() and back.where("text IS NULL AND size(ids) = 0").count() == 1


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(6)
    rows = []
    for g in range(12):
        base = [f"w{g}_{i}" for i in range(r.randint(3, 120))]
        for _ in range(r.randint(1, 9)):
            own = [f"v{r.random()}" if r.random() < r.choice((0, 0.02, 0.04)) else w for w in base]
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {d: frozenset(tuple(t.split()[i : i + 5]) for i in range(max(len(t.split()) - 4, 1))) for d, t in rows}
    parent = {d: d for d, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    got = {x.doc_id: (x.n_shingles, x.component) for x in minhash.near_duplicates(docs).collect()}
    assert got == {d: (len(sets[d]), top(d)) for d in sets}
    odd = minhash.near_duplicates(awkward(spark)).collect()
    assert len(odd) == 7 and all(x.component == x.doc_id for x in odd)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_nearest_of_few_vectors(spark):
    x = np.random.default_rng(2).normal(size=(300, 8)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, df.where("vec_id % 20 = 0").select("vec_id"), 20).toPandas()
    hits = 0
    for q in range(0, 300, 20):
        own = got[got.query_id == q].sort_values("rank")
        score = x.astype(float) @ x[q].astype(float)
        want = [i for i in np.lexsort((np.arange(300), -score)) if i != q][:20]
        hits += len(set(want) & set(own.vec_id))
        assert list(own["rank"]) == list(range(1, 21)) and np.allclose(own.score, score[own.vec_id])
        if 100 <= q < 140:
            assert list(own.vec_id)[:20] == want
    assert hits >= 0.9 * 15 * 20 and len(got) == 300
    assert neighbours.nearest(df.limit(0), df.select("vec_id")).count() == 0


def test_nearest_of_many_lists(spark):
    x = np.random.default_rng(5).normal(size=(20_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], schema).repartition(8)
    got = neighbours.nearest(df, df.where("vec_id % 200 = 0").select("vec_id"), 20).toPandas()
    assert len(got) == 100 * 20 and not got.duplicated(["query_id", "vec_id"]).any()
    hits = 0
    for q, own in got.groupby("query_id"):
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20]) & set(own.vec_id))
    assert hits >= 0.98 * 100 * 20


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    scored = queries.op10_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good = scored.quality == 1
    assert scored.predicted[good].mean() > 0.97 and scored.predicted[~good].mean() < 0.15
    model = quality.fit(np.zeros((quality._ROWS, quality.SIZE)), np.zeros((0, 65)), np.zeros(0))
    assert {r.score for r in quality.score(awkward(spark), model).collect()} == {0.5}


def test_lines_and_spans_on_awkward_rows(spark):
    docs = awkward(spark)
    clean = lines.without_boilerplate(docs, F.col("source"))
    assert clean.columns == docs.columns and sorted(map(str, clean.collect())) == sorted(map(str, docs.collect()))
    page = spark.createDataFrame([(i, f"Home | About\nown {i}", "h") for i in range(6)], "doc_id long, text string, source string")
    assert {r.text for r in lines.without_boilerplate(page, F.col("source")).collect()} == {f"own {i}" for i in range(6)}
    passage = "The first sentence of some length. The second one, longer still! And a third to end it?"
    texts = spark.createDataFrame([(1, f"Own a. {passage} Own b."), (2, f"Other words {passage} And more."), (3, "Clean. Text.")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in spans.without_repeats(texts).collect()}
    assert got[1].startswith("Own a. The first") and got[3] == "Clean. Text." and "second" not in got[2] and got[2].endswith("And more.")
    assert spans.without_repeats(docs).count() == 7


def test_pipeline_on_the_small_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert name == "pieces" or docs.columns == columns
        assert 0 < docs.count() <= seen
        seen = docs.count()
    assert docs.where("NOT exact").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_near_copies_keep_their_lines(spark):
    import corpus_pipeline

    r = random.Random(8)
    lines_ = lambda n: ["".join(r.choices("abcdefgh", k=6)) + " " + " ".join(r.choices(WORDS, k=11)) for _ in range(n)]
    shared, nav = lines_(20), "Home | About | Contact"
    rows = [(i, "\n".join([nav, *shared[:10], *lines_(1), *shared[10:]]), "en", "s", 9) for i in range(8)]
    rows += [(i, "\n".join([nav, *lines_(10)]), "en", "s", 9) for i in range(8, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:]:  # the texts have no labels
        docs = stage(spark, docs, FOLDER)
        if name == "decontamination":
            left = {x.doc_id: x.text for x in docs.collect()}
            want = {i: t.removeprefix(nav + "\n") for i, t, *_ in rows if i == 0 or i >= 8}
            assert left == want
    assert docs.count() == 33 and docs.where("NOT exact").count() == 0
