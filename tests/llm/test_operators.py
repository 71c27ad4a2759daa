"""Each operator against a brute-force version, and its defined results at the edges."""

import hashlib
import io
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnweave.llm import common, fingerprints, html_text, language_id, mixing, packing, sharding, simhash, token_files, toxicity, vector_graph
from tarnweave.llm.queries import ORACLE_SQL, QUERIES

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000
EDGES = [(1, "The cat sat on the mat.", "en", "a", 23), (1, "The cat sat on the mat.", "en", "a", 23), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "The cat sat", "en", "b", 11), (4, LONG, "en", "b", len(LONG)), (5, "the cat sat on the mat.", "", "", 23), (6, "ß\x00 emoji 😀 <|endoftext|>\x1c x  y\n", "xx", "c", 20)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark, data):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}


def ids_of(texts, end):
    tok = common.tokenizer(common.byte_bpe_path())
    return [np.array([*e.ids, end], "<u4") for e in tok.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(name, spark, duck, data):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    found = duck.sql(ORACLE_SQL[name])
    names = list(found.columns)
    assert sorted(names) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(dict(zip(names, r))[c] for c in columns) for r in found.fetchall()), key=repr)


# 1 ------------------------------------------------------------------------------------------------------------------
PAGES = {
    None: "", "": "", "plain &amp; text": "plain & text",
    "<html><body><nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>First  para\n with <b>bold</b>.<p>Second &eacute;.</p></article><div class='comments'>No</div><footer>f</footer></body></html>": "Title First para with bold. Second é.",
    "<body><div class='sidebar'><p>no</p></div><div><p>Long text that is the main part of this page, surely.</p><p>More of the long text, as it goes on and on.</p></div><form>no</form><script>var t='</p>'</script></body>": "Long text that is the main part of this page, surely. More of the long text, as it goes on and on.",
}


LONG_P = "<p>This is a paragraph of the story, which has some length.</p><p>So has this one, and it goes on for a while.</p>"
STORY = "This is a paragraph of the story, which has some length. So has this one, and it goes on for a while."
MORE_PAGES = {
    f"<main><article>{LONG_P}</article><article>{LONG_P}</article></main>": f"{STORY} {STORY}",
    f"<body><article>Teaser.</article><div>{LONG_P}</div></body>": STORY,
    f"<main><h1>Title</h1><article>{LONG_P}</article></main>": f"Title {STORY}",
    f"<article><section id='discussion'><p>Talk.</p></section><div id='related-work'><p>Work.</p></div><header class='entry-header'><h1>A</h1></header><div class='article-header'><h1>B</h1></div>{LONG_P}</article>": f"Talk. Work. A B {STORY}",
    f"<article><p title='the hidden truth'>One.</p><p data-x=don't>Two.</p>{LONG_P}</article>": f"One. Two. {STORY}",
    f"<body><div class='has-sidebar'>{LONG_P}</div></body>": STORY,
    f"<body><div class='sidebar'>{LONG_P}</div></body>": STORY,
    f"<body><div class='sidebar'><div class='ad-box'>{LONG_P}</div><div class=ads>x</div></div></body>": STORY,
    # without an article element
    f"<body><nav>Menu</nav><div class='ad-slot'><p>Buy</p></div><div id=x>{LONG_P}</div><div class='comments-list'>{LONG_P}</div><footer>f</footer></body>": STORY,
    f"<body><div>{LONG_P}</div><ul><li><a href=1>One link</a><li><a href=2>Other link</a></ul><form><p>Subscribe now</p></form></body>": STORY,
    f"<body><table><tr><td><a href=1>Home</a><td>{LONG_P}</table><div class=cookie-notice><p>We use cookies.</p></div></body>": STORY,
    f"<body><div hidden>{LONG_P}</div><section>{LONG_P}</section><aside>{LONG_P}</aside></body>": STORY,
    f"<body><div id=a><div id=b>{LONG_P}<script>if (a<b) document.write('<p>no</p>')</script></div></div><div role=navigation>Links</div></body>": STORY,
    f"<body><h1>Head</h1><div>{LONG_P}</div></body>": f"Head {STORY}",
    # names are weights, and densities decide
    f"<article>{LONG_P}<div class='comment-thread'><p>Great story, I enjoyed every word of it, thank you.</p></div></article>": STORY,
    f"<article>{LONG_P}<div id=commentThread><p>Great story, I enjoyed every word of it, thank you.</p></div></article>": STORY,
    f"<article>{LONG_P}<div class='related-articles-grid'><p>Ten more stories that you may like to read as well.</p></div></article>": STORY,
    f"<body><div class='sidebar-left-col'><p>The weather will be fine on most days of this week.</p></div><div>{LONG_P}</div></body>": STORY,
    f"<body><div role=main><p class='notice'>Notice of the meeting.</p>{LONG_P}</div></body>": f"Notice of the meeting. {STORY}",
    f"<article>{LONG_P}<section id='share'><p>The share of the market rose by a tenth in the first three months of the year.</p></section></article>": f"{STORY} The share of the market rose by a tenth in the first three months of the year.",
    f"<article>{LONG_P}<div class='share'><a href=1>Post</a> <a href=2>Mail</a> <a href=3>Link</a></div></article>": STORY,
    f"<body><h2>Head</h2><p>Intro short.</p><div>{LONG_P}</div><p>End.</p></body>": f"Head Intro short. {STORY}",
    f"<body><p>Advertisement</p><h2>Head</h2><div>{LONG_P}</div></body>": f"Head {STORY}",
    f"<body><h2>Latest</h2><ul><li><a href=1>One link</a><li><a href=2>Other link</a></ul><div>{LONG_P}</div></body>": STORY,
    f"<article>loose text <a href=1>a link</a> <div>{LONG_P}</div><div><a href=1>One link of a list</a><a href=2>Another link of it</a></div></article>": f"loose text a link {STORY}",
    f"<body><article><p><a href=1>First teaser</a></p><p><a href=2>Second teaser</a></p></article><div>{LONG_P}</div></body>": STORY,
    "a < b <3 &lt;": "a < b <3 <", "<p>open <b>text": "open text", "<!-- x": "", "text<!-- x": "text",
}


@pytest.mark.parametrize("html", list(MORE_PAGES))
def test_main_text_of(html):
    assert html_text.main_text(html) == MORE_PAGES[html]


@pytest.mark.parametrize("unit", ['<a "', "<div class='", "<p>x<i>", "<li>", "<!--", "<a href=x", "<script>", "<div class=ad>x", "</b><i>", "<main><p>x</p><div class=share>y</div>", "<h2>x</h2>"])
def test_broken_html_takes_linear_time(unit):
    import time

    def seconds(n):
        began = time.process_time()
        html_text.main_text(unit * (n // len(unit)))
        return time.process_time() - began

    assert seconds(1_600_000) < 8 * seconds(400_000) + 1


def test_main_text(spark, data):
    pages = spark.createDataFrame([(i, "u", h, "x", "y") for i, h in enumerate([*PAGES, *PAGES])], "page_id long, url string, html string, text string, n_chars string")
    found = html_text.with_main_text(pages).orderBy("page_id").collect()
    assert [r.text for r in found] == [*PAGES.values(), *PAGES.values()] and all(r.n_chars == len(r.text) for r in found)
    assert html_text.with_main_text(pages.where("false")).count() == 0
    rows = QUERIES["op1_main_text"](spark, data).collect()
    import re
    from html import unescape

    for r, p in zip(sorted(rows), spark.read.parquet(f"{data}/pages.parquet").orderBy("page_id").collect(), strict=True):
        article = re.sub(r"</?(?:p|h1|br)>", "\0", re.search(r"<article>(.*)</article>", p.html, re.S)[1])
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in article.split("\0")]
        assert (r.page_id, r.url, r.text) == (p.page_id, p.url, " ".join(b for b in blocks if b))


# 2 ------------------------------------------------------------------------------------------------------------------
def test_encoder_equals_library():
    texts = [r[1] or "" for r in EDGES] + ["it's  we'll\tdo\r\n 12³ ½a ...--é\xa0x  ", " a", "a ", "\n\n", "don't 'S"]
    assert [bytes(x) for x in common.Encoder(common.byte_bpe_path()).encode(texts)] == [a[:-1].tobytes() for a in ids_of(texts, 0)]


def test_token_files(spark, docs, data):
    at = 0
    rows = QUERIES["op2_token_planes"](spark, data).orderBy("doc_id").collect()
    for r, ids in zip(rows, ids_of([docs[k] for k in sorted(docs)], 2), strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@pytest.mark.parametrize("bits", [False, True])
def test_plane_file(bits):
    out, given = io.BytesIO(), [(i, np.arange(n, dtype="<u4").tobytes()) for i, n in enumerate([0, 1, 70_000, 3, 65_536])] + [(None, b"\1\0\0\0")]
    writer = token_files.PlaneWriter(out, bits)
    for key, ids in given:
        writer.add(key, ids)
    writer.close()
    assert list(token_files.PlaneReader(out).documents()) == given


def test_token_files_edges(spark, edges, empty):
    found = token_files.read_token_files(token_files.write_token_files(edges, common.new_path(spark, "t"), common.byte_bpe_path())).collect()
    assert len(found) == len(EDGES) and found[0].start == 0 or min(r.start for r in found) == 0
    assert sorted(len(r.ids) for r in found) == sorted(4 * len(x) for x in ids_of([r[1] or "" for r in EDGES], 2))
    assert token_files.read_token_files(token_files.write_token_files(empty, common.new_path(spark, "t"), common.byte_bpe_path())).count() == 0


# 3 ------------------------------------------------------------------------------------------------------------------
def test_language(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = language_id.learn(docs)
    rows = spark.createDataFrame([(1, "Le chat est dans la maison avec une amie pour les vacances", "s"), (2, None, None), (3, "12 34 !!", "s"), (4, "中文文本没有空格中文文本中文文本没有空格", "s"), (1, "Le chat est dans la maison avec une amie pour les vacances", "s")], "doc_id long, text string, source string")
    found = language_id.identify_documents(rows, model).orderBy("doc_id").collect()
    assert [(r.doc_id, r.accepted) for r in found] == [(1, True), (1, True), (2, False), (3, False), (4, False)]
    assert found[0].lang_id == "fr" and [r.lang_id for r in found[2:]] == ["und"] * 3
    held = QUERIES["op3_language_id"](spark, data).where("kind = 'document'").join(docs.select("doc_id", "lang"), "doc_id")
    assert held.agg(F.avg((F.col("lang_id") == F.col("lang")).cast("int"))).first()[0] > 0.97
    assert language_id.identify_documents(rows.where("false"), model).count() == 0
    assert {r.lang_id for r in language_id.identify_documents(rows, language_id.learn(docs.where("false"))).collect()} == {"und"}


def test_address(spark):
    rows = spark.createDataFrame([("https://u@A.b.example.FR:80/x",), (None,), ("nonsense",)], "u string")
    assert [tuple(r) for r in rows.select(*language_id.address(F.col("u"))).collect()] == [("fr", "example.fr", "b.example.fr", "a.b.example.fr"), ("",) * 4, ("",) * 4]


def test_markup_and_host_decide(spark, data):
    """The same short text falls to the languages that its page declares and that its host's other pages have."""
    model = language_id.learn(spark.read.parquet(f"{data}/documents.parquet"))
    page = "<html lang='{}'><body><article>{}</article></body></html>"
    french, german = "le chat est dans la maison avec les amis", "der hund ist nicht in dem haus mit den kindern und"
    rows = [(i, "http://x.fr/", page.format("fr", french)) for i in range(20)] + [(50 + i, "http://y.de/", page.format("de", german)) for i in range(20)] + [(90, "http://x.fr/", page.format("fr", "ch")), (91, "http://y.de/", page.format("de", "ch"))]
    found = {r.page_id: r.lang_id for r in language_id.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert (found[90], found[91]) == ("fr", "de")


def test_declared_language():
    found = language_id.declared_language
    assert found("<!-- " + "x" * 10_000 + " <html lang=de> --><!DOCTYPE html>\n<HTML class='a' xml:lang = 'FR-ca'>") == "fr"
    assert found("<html data-lang=en><p lang=de>") is None and found("") is None and found("<!-- open <html lang=de>") is None


def test_many_languages(spark):
    rows = spark.createDataFrame([(i * 300 + j, f"l{i:03d}", f"{chr(97 + i % 26)}{chr(97 + i // 26)}x{chr(97 + i % 26)}q word") for i in range(201) for j in range(3)], "doc_id long, lang string, text string")
    assert len(language_id.learn(rows).languages) == 201
    with pytest.raises(ValueError):
        language_id.learn(rows, most=200)
    chosen = language_id.sampled(rows.select(F.col("doc_id").alias("k"), F.lit("x").alias("l")).unionAll(rows.select(F.lit(5), F.lit("y"))), 100).groupBy("l").count().collect()
    assert {r.l: r["count"] for r in chosen} == {"x": 100, "y": 1}


def test_language_outside_the_sample(spark, data):
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    even, odd = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 AND text RLIKE '[A-Za-z]'")
    found = language_id.identify_documents(odd, language_id.learn(even)).join(odd.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang_id") == F.col("lang")).cast("int"))).first()[0] > 0.97


# 4 ------------------------------------------------------------------------------------------------------------------
def plain_components(values, linked):
    root = {k: k for k in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if linked(values[a], values[b]) and root[a] != root[b]:
                    low = min(root[a], root[b])
                    root[a] = root[b] = low
                    changed = True
    return root


def test_simhash_links(spark):
    fps = {i: fp for i, fp in enumerate([0, 3, 15, 1 << 62, (1 << 63) | (1 << 61) | 7, 0b111111, 1 << 63, (1 << 63) | 1, 0])}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = spark.createDataFrame([(k, signed(v)) for k, v in fps.items()], "doc_id long, fp long")
    found = {r.doc_id: r.component_id for r in simhash.near_duplicate_classes(prints).collect()}
    assert found == plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)


def test_simhash_query(spark, docs, data):
    """Fingerprints bit by bit in plain Python, links by all pairs."""
    import re

    import xxhash

    fps = {}
    for k, text in docs.items():
        own = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        shingles = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))] if own else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps[k] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash_near_dedup"](spark, data).collect()}
    assert found == {k: (f"{fps[k]:016x}", root[k]) for k in fps}


def test_simhash_edges(spark, edges, empty):
    prints = common.materialise(simhash.with_fingerprints(edges), "p")
    found = {(r.doc_id, r.fp) for r in prints.collect()}
    assert (2, 0) in found and (3, 0) in found and len(found) == len(EDGES) - 1
    classes = simhash.near_duplicate_classes(prints).collect()
    assert len(classes) == len(EDGES) and {r.component_id for r in classes if r.doc_id in (1, 5)} == {1}
    assert simhash.near_duplicate_classes(common.materialise(simhash.with_fingerprints(empty), "p")).count() == 0


# 5 ------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(4))
def test_pack_lengths(seed):
    sizes = np.random.default_rng(seed).choice([1, 5, 30, 400, 700, 1000, 1500, 2048], 500)
    sequence, offset = packing.pack_lengths(sizes, 2048)
    for s in np.unique(sequence):
        own = np.flatnonzero(sequence == s)
        own = own[np.argsort(offset[own])]
        assert sizes[own].sum() <= 2048 and list(offset[own]) == [0, *np.cumsum(sizes[own])[:-1]] and (sizes[own] * 3 > 2048).sum() <= 2
    assert len(np.unique(sequence)) <= sizes.sum() / 2048 * 1.25 + 1


def test_packing_edges(spark, edges, empty, docs, data):
    rows = packing.pack_documents(edges, common.byte_bpe_path()).collect()
    assert sorted(sum(1 for r in rows if r.doc_id == k and r.piece == 0) for k in (1, 2, 3, None)) == [1, 1, 1, 2]
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 4)
    assert all(n == 2048 for p, _, n in long if p) and [s for _, s, _ in long] == [0, *np.cumsum([n for *_, n in long])[:-1]]
    assert packing.pack_documents(empty, common.byte_bpe_path()).count() == 0
    kept = packing.pack_documents(edges, common.byte_bpe_path()).where("doc_id = 6").first()
    assert zlib.crc32(kept.ids) == kept.ids_crc32 and len(kept.ids) == 4 * kept.length
    packed = QUERIES["op5_best_fit_packing"](spark, data).toPandas()
    own = dict(zip(docs, ids_of(list(docs.values()), 0)))
    for r in packed.itertuples():
        assert r.ids_crc32 == zlib.crc32(own[r.doc_id][r.start : r.start + r.length].tobytes())
    for _, pieces in packed.sort_values("piece").groupby("doc_id"):
        assert list(pieces.piece) == list(range(len(pieces))) and list(pieces.start) == [0, *pieces.length.cumsum()[:-1]] and (pieces.length[1:] == 2048).all()
    for _, pieces in packed.sort_values("offset").groupby("sequence_id"):
        assert list(pieces.offset) == [0, *pieces.length.cumsum()[:-1]]
    assert packed.sequence_id.nunique() <= packed["length"].sum() / 2048 * 1.02 + 1
    assert packed["length"].sum() == sum(map(len, ids_of(list(docs.values()), 0))) and packed.groupby("sequence_id")["length"].sum().max() <= 2048


# 6 ------------------------------------------------------------------------------------------------------------------
def test_toxicity_held_out(spark, data):
    sf = data.replace("sf0.001", "sf0.1")  # the smaller tables hold too few toxic texts to learn from
    found = QUERIES["op6_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    right = found[found.toxic == 1].predicted.mean(), 1 - found[found.toxic == 0].predicted.mean()
    assert right[0] >= 0.7 and right[1] >= 0.99


def test_toxicity_edges(spark, edges, empty):
    none = toxicity.fit_on(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.with_toxicity(edges.withColumn("score", F.lit(9.0)), none).collect()} == {0.0}
    one = toxicity.fit_on(edges, spark.createDataFrame([(1, 1), (4, None), (3, 5)], "doc_id long, toxic int"))
    assert toxicity.with_toxicity(edges, one, keep=["doc_id"]).count() == len(EDGES) and toxicity.with_toxicity(empty, one).count() == 0


# 7 ------------------------------------------------------------------------------------------------------------------
def test_sharding(spark, edges, empty):
    shards = sharding.ShardedTable(spark, common.new_path(spark, "s"), target_bytes=1 << 20, fan_in=3)
    for _ in range(4):
        shards.append(edges.withColumn("path", F.lit("clash")), shard_rows=2)
    shards.append(empty.withColumn("path", F.lit("clash")))
    before = shards.manifest().count()
    assert shards.read(1).count() == len(EDGES) and shards.versions() == [1, 2, 3, 4, 5]
    assert shards.compact() == 6 and shards.manifest().count() < before
    assert sorted(map(repr, shards.read().collect())) == sorted(map(repr, [r for r in edges.withColumn("path", F.lit("clash")).collect() for _ in range(4)]))
    with pytest.raises(sharding.VersionTaken):
        shards._commit(6, shards.manifest(), edges.schema)
    shards.expire()
    assert shards.versions() == [1, 2, 3, 4, 5, 6] and shards.read(3).count() == 3 * len(EDGES)  # readable after the merge
    shards.expire(older=-1)
    assert shards.versions() == [6] and shards.read().count() == 4 * len(EDGES)
    assert sharding.ShardedTable(spark, common.new_path(spark, "s")).compact() is None


# 8 ------------------------------------------------------------------------------------------------------------------
def clustered(n=600, seed=0):
    chance = np.random.default_rng(seed)
    centres = chance.normal(size=(40, 16))
    v = centres[chance.integers(0, 40, n)] + chance.normal(size=(n, 16)) * chance.choice([0.03, 0.1, 0.4], n)[:, None]
    v[: n // 3] = centres[0] + chance.normal(size=(n // 3, 16)) * 0.03
    return v.astype(np.float32)


@pytest.mark.parametrize("shard_rows", [100, 10_000])
def test_vectors(spark, shard_rows):
    v = clustered()
    labels = np.arange(len(v)) % 2
    rows = [(int(i), x.tolist(), int(k)) for i, (x, k) in enumerate(zip(v, labels))]
    odd = [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [float("nan")] * 16, 1), (1004, [1.0] * 15 + [None], 1), (1005, v[0].tolist(), None), (None, v[0].tolist(), 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: r for r in vector_graph.near_duplicate_vectors(df, shard_rows=shard_rows).collect()}
    x = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (labels[:, None] == labels[None, :])
    root = vector_graph.roots_of(*np.nonzero(near), len(v))
    assert [found[i].n_links for i in range(len(v))] == (near.sum(1) - 1).tolist()
    assert [found[i].component_id for i in range(len(v))] == root.tolist()
    assert all(found[i].n_links == 0 and found[i].kept for i in (*range(1000, 1006), None)) and len(found) == len(rows) + len(odd)
    assert vector_graph.near_duplicate_vectors(df.where("false")).count() == 0


def test_repeated_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0)], "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in vector_graph.near_duplicate_vectors(df).collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_graph_recall():
    v = vector_graph.unit(clustered(3000, 1))
    ids, _ = vector_graph.Graph(v).search(v[:200], 48)
    best = np.argsort(-(v[:200] @ v.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, best)]) > 0.9


# 9 ------------------------------------------------------------------------------------------------------------------
def test_mixing(spark, edges, empty):
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") < 15_000, "big").otherwise(None).alias("source"), F.lit(7).alias("copy_no"))
    shares = {r.source: r["count"] / 20_000 for r in mixing.mix_sources(many, exponent=0.0).groupBy("source").count().collect()}
    assert abs(shares["big"] - 0.5) < 0.02 and abs(shares[None] - 0.5) < 0.02
    weighted = mixing.mix_sources(many, {"big": 1.0}, repeat=80.0).groupBy("source").count().collect()
    assert [r.source for r in weighted] == ["big"] and abs(weighted[0]["count"] / (80 * 20_000) - 1) < 0.02
    few, rates = many.select("doc_id", "text", "source"), mixing.source_rates(many, None, 0.0, 1.0)
    salted, plain = (mixing._with_rates(few, rates, "doc_id", most).groupBy("source", "rate").count() for most in (0, 10))
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))
    assert mixing.mix_sources(edges).columns == [*edges.columns, "copy_no", "shuffle_key"] and mixing.mix_sources(empty).count() == 0


# 10 -----------------------------------------------------------------------------------------------------------------
def canonical(t):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())


def test_fingerprints(spark, docs, data):
    rows = {r.doc_id: r for r in QUERIES["op10_document_fingerprints"](spark, data).collect()}
    keys = sorted(docs)
    for i, k in enumerate(keys):
        text, after = docs[k], docs[keys[(i + 1) % len(keys)]]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        r = rows[k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(canonical(text) == canonical(edited)), float(canonical(text) == canonical(after)))
        assert all((rows[j].fingerprint == r.fingerprint) == (canonical(docs[j]) == canonical(text)) for j in keys[:40])


def test_fingerprints_with_forced_collisions(spark, monkeypatch):
    """With a digest of 16 values, bytes decide for documents, edited texts and next documents alike."""
    monkeypatch.setattr(fingerprints, "digest", lambda form: F.substring(F.md5(form), 1, 1))
    texts = [f"{'abcdefghij'[i % 10] * 3} {i % 23}" for i in range(60)] + ["same  Text"] * 4 + ["", None, "A", "a"]
    df = spark.createDataFrame([(i // 2 if i > 62 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = fingerprints.edited_fingerprints(df).collect()
    order = sorted(((i // 2 if i > 62 else i, t or "") for i, t in enumerate(texts)))
    assert len(rows) == len(order)
    want, forms = [], {}
    for i, (k, text) in enumerate(order):
        after, cut = order[(i + 1) % len(order)][1], len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        want.append((k, len(text), hashlib.sha256(edited.encode()).hexdigest(), float(canonical(text) == canonical(edited)), float(canonical(text) == canonical(after))))
        forms[(k, want[-1][2], len(text))] = canonical(text), canonical(edited)
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows) == sorted(want)
    pairs = {(forms[(r.doc_id, r.edited_sha256, r.n_chars)][0], r.fingerprint) for r in rows} | {(forms[(r.doc_id, r.edited_sha256, r.n_chars)][1], r.edited_fingerprint) for r in rows}
    assert len({f for f, _ in pairs}) == len({p for _, p in pairs}) == len(pairs)


def test_fingerprint_edges(spark, edges, empty):
    found = fingerprints.exact_fingerprints(edges.withColumn("fingerprint", F.lit("x"))).collect()
    by = {r.doc_id: r.fingerprint for r in found}
    assert len(found) == len(EDGES) and by[1] == by[5] and by[2] == by[3] and len({*by.values()}) == 5
    assert fingerprints.exact_fingerprints(empty).count() == 0
    same = spark.createDataFrame([("d", "a"), ("d", "b"), ("d", "a"), ("e", "a")], "digest string, form string")
    assert [tuple(r) for r in fingerprints.collision_ranks(same).collect()] == [("d", "b", 1)]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (3, 1), *[(100, k) for k in range(101, 140)]], "a long, b long")
    found = {r.node: r.component for r in common.connected_components(edges).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 100: 100, **{k: 100 for k in range(101, 140)}}
