import json
import random
import sqlite3
import struct
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.sources import files, packed, result_pages, store_files


def terms(rows):
    return sorted((tuple(r) for r in rows.select("dict_name", "domain", "type", "term").collect()), key=str)


def test_any_number_of_dictionaries_is_written_and_read(spark, tmp_path):
    rows = [(f"d{k % 6}", None if k % 6 == 5 else f"m{k % 2}", f"t{k % 4}", f"term {k}") for k in range(120)] + [("d0", "m0", "t0", "term 0"), ("ünï/code ☃", "m", "t", 'quo"te\n')]
    df = spark.createDataFrame(rows + [("d1", "m1", "t", None)], "dict_name string, domain string, type string, term string")
    for n, file_terms in ((100_000, 100_000), (7, 7)):
        out = str(tmp_path / f"out{n}")
        files.write_dictionary(df, out, file_terms)
        assert terms(files.read_dictionaries(spark, out)) == sorted({tuple(r) for r in rows}, key=str)
    for file in (tmp_path / "out7").glob("*.json"):
        assert json.loads(file.read_text())["entities"]  # one object, as a person would write it
    files.write_dictionary(df.where("false"), str(tmp_path / "none"))


def test_lines_of_dictionaries_are_read_too(spark, tmp_path):
    one = lambda n: {"metadata": {"name": n, "domain": "m"}, "entities": {"t": [n + "x"]}}
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(one(n)) for n in "abc") + "\n\n")
    (tmp_path / "wide.json").write_text(json.dumps(one("d"), indent=2))
    assert {r.term for r in files.read_dictionaries(spark, str(tmp_path)).collect()} == {"ax", "bx", "cx", "dx"}


def test_import_merges_or_replaces(spark):
    kind = "dict_name string, domain string, type string, term string"
    old = spark.createDataFrame([("a", "m", "t", "x"), ("a", "m", "u", "y"), ("b", "m", "t", "z")], kind)
    new = spark.createDataFrame([("a", "m", "t", "x"), ("a", "m", "t", "w"), ("a", "m", "t", "w")], kind)
    got = lambda merge: sorted((r.dict_name, r.type, r.term) for r in files.import_terms(old, new, merge).collect())
    assert got(True) == [("a", "t", "w"), ("a", "t", "x"), ("a", "u", "y"), ("b", "t", "z")]
    assert got(False) == [("a", "t", "w"), ("a", "t", "x"), ("b", "t", "z")]


class Tree(HTMLParser):
    """A whole tree, for comparison: nodes are (tag, attrs, children), texts are strings."""

    def __init__(self, html):
        super().__init__()
        self.root = ("", {}, [])
        self.path = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = (tag, dict(attrs[::-1]), [])
        self.path[-1][2].append(node)
        if tag not in result_pages.VOID:
            self.path.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in result_pages.VOID:
            self.path.pop()

    def handle_endtag(self, tag):
        if tag in [n[0] for n in self.path[1:]]:
            while self.path.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.path[-1][2].append(data)


def walk(node):
    for c in node[2]:
        if isinstance(c, tuple):
            yield c
            yield from walk(c)


def text(node):
    if node[0] in result_pages.HIDDEN:
        return ""
    return "".join(c.strip() if isinstance(c, str) else text(c) for c in node[2])


def by_tree(html, most=10):
    root, classes = Tree(html).root, lambda n: (n[1].get("class") or "").split()
    for tag, cls in result_pages.KINDS:
        out = []
        for i, e in enumerate([n for n in walk(root) if n[0] == tag and (cls is None or cls in classes(n))][:most]):
            if cls == "result":
                link = next((n for n in walk(e) if n[0] == "a" and "result__a" in classes(n)), None)
                about = next((n for n in walk(e) if n[0] == "a" and "result__snippet" in classes(n)), None)
            else:
                link = next((n for n in walk(e) if n[0] == "a"), None)
                about = next((n for n in walk(e) if n[0] in ("p", "span", "div") and any("snippet" in c.lower() for c in classes(n))), None)
            if link:
                out.append({"place": i, "title": text(link), "url": link[1].get("href") or "", "snippet": text(about) if about else ""})
        if out:
            return out
    return []


def random_page(rng):
    parts = []
    for _ in range(rng.randint(0, 40)):
        tag = rng.choice(["div", "a", "p", "span", "article", "b", "script", "br", "div", "a"])
        cls = rng.choice(["", ' class="result"', ' class="x result"', ' class="web-result"', ' class="result__body"', ' class="result__a"', ' class="result__snippet"', ' class="My-Snippet"', " class"])
        parts.append(rng.choice([f"<{tag}{cls}{rng.choice(['', ' href=u' + str(rng.randint(0, 9))])}>", f"</{tag}>", f" word{rng.randint(0, 9)} &amp; ", "<!-- no -->", "x", "<", f"<{tag}{cls}/>"]))
    return "".join(parts)


def test_result_pages_equal_a_tree_walk():
    rng = random.Random(4)
    pages = [random_page(rng) for _ in range(4000)]
    found = [result_pages.page_hits(p) for p in pages]
    assert found == [by_tree(p) for p in pages]
    assert sum(map(bool, found)) > 300


def test_hits_of_hand_written_pages(spark):
    page = '<div class="result results_links"><h2><a class="result__a" href="//x?u=1">A <b>title</b></a></h2><a class="result__snippet">some &amp; <b>text</b></a></div><div class="result">no link</div><div class="result"><a class="result__a" href="v">B</a></div>'
    df = spark.createDataFrame([(1, page), (2, None), (3, "<p>nothing"), (4, '<article><a href="w">C</a></article>')], "query_id int, html string")
    got = [(r.query_id, r.engine_rank, r.title, r.url, r.snippet, r.score) for r in result_pages.duckduckgo_hits(df).orderBy("query_id", "engine_rank").collect()]
    assert got == [(1, 1, "Atitle", "//x?u=1", "some &text", 1.0), (1, 3, "B", "v", "", 0.8), (4, 1, "C", "w", "", 1.0)]
    entry = '<title> 水 _百度百科</title><meta name="description" content="百度百科水是' + "长" * 400 + '">'
    df = spark.createDataFrame([(1, "u", entry), (2, "u", "<title>x</title>"), (3, "u", "<title>y_百度百科</title>"), (4, "u", None)], "query_id int, url string, html string")
    got = {r.query_id: (r.title, r.snippet) for r in result_pages.baike_hits(df).collect()}
    assert got == {1: ("水", "水是" + "长" * 298 + "..."), 3: ("y", "词条: y")}


def pack(v):
    """A plain packer, for comparison."""
    if v is None or isinstance(v, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[v]
    if isinstance(v, int):
        return struct.pack("b", v) if -32 <= v < 128 else b"\xd3" + struct.pack(">q", v)
    if isinstance(v, float):
        return b"\xcb" + struct.pack(">d", v)
    if isinstance(v, str):
        raw = v.encode()
        return (bytes([0xA0 | len(raw)]) if len(raw) < 32 else b"\xda" + struct.pack(">H", len(raw))) + raw
    if isinstance(v, bytes):
        return b"\xc4" + bytes([len(v)]) + v
    if isinstance(v, list):
        return (bytes([0x90 | len(v)]) if len(v) < 16 else b"\xdc" + struct.pack(">H", len(v))) + b"".join(map(pack, v))
    return (bytes([0x80 | len(v)]) if len(v) < 16 else b"\xde" + struct.pack(">H", len(v))) + b"".join(pack(k) + pack(x) for k, x in v.items())


leaf = st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.floats(allow_nan=False) | st.text(max_size=40) | st.binary(max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.recursive(leaf, lambda x: st.lists(x, max_size=20) | st.dictionaries(st.text(max_size=8), x, max_size=20), max_leaves=40))
def test_packed_values_round_trip_and_cuts_are_found(v):
    raw = pack(v)
    assert packed.unpack(raw) == v
    for n in {0, len(raw) // 2, len(raw) - 1}:
        with pytest.raises(packed.Cut):
            packed.unpack(raw[:n])
    with pytest.raises(packed.Cut):
        packed.unpack(raw + b"\x00")


def test_packed_checkpoints(spark):
    ext = lambda v: b"\xc7" + bytes([len(pack(v)), 5]) + pack(v)
    messages = [{"type": "human", "content": "hello there"}, {"content": "short"}, {"type": "ai", "content": "y" * 250}, 7]
    object_ = b"\x81" + pack("messages") + b"\x91" + ext(["langchain_core.messages.ai", "AIMessage", {"content": "from an object"}])
    rows = [(1, pack({"channel_values": {"messages": messages}})), (2, pack({"messages": []})), (3, b"\xc1"), (4, None), (5, b"\x91" * 5000), (6, pack({"messages": messages})[:-3]), (7, object_), (8, b"\x80\x04\x95 pickle"), (9, pack({"state": {"messages": messages[:1]}}))]
    df = spark.createDataFrame(rows, "id int, blob binary")
    got = sorted(tuple(r) for r in packed.checkpoint_blobs(df, "id", "blob").collect())
    assert got == [(1, 0, "human", "hello there"), (1, 2, "ai", "y" * 200 + "..."), (7, 0, "ai", "from an object"), (9, 0, "human", "hello there")]


@pytest.mark.parametrize("page_size,encoding", [(512, "UTF-8"), (4096, "UTF-16le"), (65536, "UTF-8")])
def test_sqlite_tables(spark, tmp_path, page_size, encoding):
    path = f"{tmp_path}/store.db"
    with sqlite3.connect(path) as c:
        c.execute(f"PRAGMA page_size = {page_size}")
        c.execute(f"PRAGMA encoding = '{encoding}'")
        c.execute("CREATE TABLE other (x)")
        c.execute('CREATE TABLE IF NOT EXISTS docs_main (id TEXT PRIMARY KEY, "the text" TEXT NOT NULL DEFAULT (\'a,b\'), n INTEGER, r REAL, raw BLOB, seen TIMESTAMP DEFAULT CURRENT_TIMESTAMP, UNIQUE (n, r))')
        rows = [(f"id{k}", "té" * (k % 3000), -(7**k) % 2**62 if k < 40 else k - 500, k / 3, bytes(range(k % 256)), None if k % 7 else "2024-01-02 03:04:05") for k in range(3000)]
        c.executemany("INSERT INTO docs_main VALUES (?, ?, ?, ?, ?, ?)", rows)
        c.execute("DELETE FROM docs_main WHERE n % 5 = 0")
        c.execute("CREATE TABLE small (k INTEGER PRIMARY KEY, v)")
        c.executemany("INSERT INTO small VALUES (?, ?)", [(5, None), (-3, "x"), (1 << 40, 2.5)])
        c.execute("ALTER TABLE small ADD COLUMN late TEXT")
        want = sorted(c.execute("SELECT rowid, * FROM docs_main").fetchall())
    df = store_files.read_table(spark, path, "docs_main")
    assert df.columns == ["_rowid", "id", "the text", "n", "r", "raw", "seen"]
    assert sorted((r[0], r[1], r[2], r[3], r[4], bytes(r[5]), r[6]) for r in df.collect()) == want
    assert page_size > 4096 or 4 < df.rdd.getNumPartitions() <= 256
    some = store_files.read_table(spark, path, "docs_main", low=100, high=220)
    assert sorted(r.id for r in some.collect()) == sorted(r[1] for r in want if 100 <= r[0] <= 220)
    assert some.rdd.getNumPartitions() <= df.rdd.getNumPartitions()
    assert sorted((r.k, None if r.v is None else bytes(r.v), r.late) for r in store_files.read_table(spark, path, "small").collect()) == [(-3, b"x", None), (5, None, None), (1 << 40, b"2.5", None)]
    with pytest.raises(Exception, match="no table"):
        store_files.read_table(spark, path, "missing")


def test_a_store_with_vectors(spark, tmp_path):
    with sqlite3.connect(f"{tmp_path}/vectors.db") as c:
        c.execute("CREATE TABLE docs_a_b (id TEXT PRIMARY KEY, text TEXT NOT NULL, metadata TEXT NOT NULL)")
        c.executemany("INSERT INTO docs_a_b VALUES (?, ?, ?)", [('q"1', "one", '{"k": "v"}'), ("二", "two", "{}"), ("3", "no vector", "{}")])
    vectors = {'q"1': [1.0, -2.5e-7], "二": [], "unused": [3]}
    (tmp_path / "vectors_a-b.json").write_text(json.dumps(vectors))
    got = {r.id: (r.text, r.metadata, r.vector) for r in store_files.read_store(spark, str(tmp_path), "a-b").collect()}
    assert got == {'q"1': ("one", {"k": "v"}, [1.0, -2.5e-7]), "二": ("two", {}, []), "3": ("no vector", {}, None)}
    (tmp_path / "wide.json").write_text(json.dumps(vectors, indent=1, ensure_ascii=False))
    assert {r.id: r.vector for r in store_files.read_vectors(spark, f"{tmp_path}/wide.json").collect()} == vectors
    (tmp_path / "empty.json").write_text("{}")
    assert store_files.read_vectors(spark, f"{tmp_path}/empty.json").count() == 0
    (tmp_path / "odd.json").write_text(json.dumps({"a]b": [1.0]}))
    with pytest.raises(Exception, match="no entry"):
        store_files.read_vectors(spark, f"{tmp_path}/odd.json").collect()
