import io
import random
import struct
import zipfile

import numpy as np
import pytest
from pyarrow import fs

from aerolith.llm import html_extract as H
from aerolith.llm import pq_dedup, warc_zip
from aerolith.llm.common import forest, fresh_path, table
from aerolith.llm.queries import ORACLES, QUERIES
from tests.conftest import SF01

PAGES = "page_id long, url string, html string, digest string"


def same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF01).collect()
    cols = sorted(got[0].asDict())
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert sorted((tuple(r[c] for c in cols) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["op1_warc_zip", "op2_benchmark_decontamination", "op6_embedding_near_dedup"])
def test_query_equals_its_sql(spark, duck, name):
    same_as_sql(spark, duck, name)


# --- WARC ------------------------------------------------------------------------------------------------------

def pages(spark):
    big, odd = "é" * 700, "x\r\n\r\nWARC/1.1\r\n" * 90
    return spark.createDataFrame(
        [(1, "http://a/1", big, "q"), (7, "http://a/2\r\nX: y", big, "q"), (None, None, big, "q"), (3, "u", odd, "q"), (2, "u", odd, "q"), (2, "u", odd, "q"),
         (4, "u", None, "q"), (5, "u", "", "q"), (6, "u", "small", "q"), (8, "u", "small", "q"), (9, "u", "z" * 3_000_000, "q")], PAGES)


def plain_records(rows):
    out = []
    for r in rows:
        html = (r.html or "").encode()
        last = max((x.page_id for x in rows if (x.html or "").encode() == html and x.page_id is not None), default=None)
        revisit = len(html) >= 1000 and last is not None and r.page_id != last
        out.append((r.page_id, len(html), "revisit" if revisit else "response", None if revisit else html))
    return sorted(out, key=str)


@pytest.mark.parametrize("package_bytes", [1, 1 << 20])
def test_round_trip(spark, package_bytes):
    df = pages(spark)
    folder = fresh_path(spark, "warc-test")
    listed = warc_zip.write_pages(df, folder, package_bytes=package_bytes)
    back = warc_zip.read_records(listed, range_bytes=2000).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, None if r.payload is None else bytes(r.payload)) for r in back), key=str) == plain_records(df.collect())
    found = warc_zip.list_packages(spark, folder)
    assert found.count() == listed.count() and warc_zip.read_records(found).count() == len(back)
    responses = {r.record_id for r in back if r.record_type == "response"}
    assert all(r.refers_to_id in responses for r in back if r.record_type == "revisit")
    store, path = fs.FileSystem.from_uri(listed.first().path)
    with zipfile.ZipFile(io.BytesIO(store.open_input_file(path).read())) as z:
        assert z.testzip() is None and z.namelist() == ["archive/data.warc.gz", "indexes/index.cdxj"]
    assert warc_zip.write_pages(df.limit(0), fresh_path(spark, "warc-test")).count() == 0
    assert warc_zip.read_records(listed.limit(0)).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_directory_reads_both_forms(zip64):
    out = io.BytesIO()
    p = warc_zip.ZipPackage(out, zip64=zip64)
    files = {f"archive/{i}.warc": bytes([i % 251]) * i for i in range(300)}
    for name, data in files.items():
        p.add(name, data)
    p.close()
    raw = out.getvalue()
    members = list(warc_zip.directory(io.BytesIO(raw), len(raw)))
    assert {m.name: raw[(s := warc_zip.data_start(io.BytesIO(raw), m)):s + m.size] for m in members} == files
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert {n: z.read(n) for n in z.namelist()} == files
    cut = raw[:-warc_zip.END_SIZE] + raw[-warc_zip.END_SIZE:-2] + struct.pack("<H", 30) + warc_zip.END + b"x" * 26  # a comment with a signature
    assert len(list(warc_zip.directory(io.BytesIO(cut), len(cut)))) == 300


def test_members_without_index_and_errors(spark):
    folder = fresh_path(spark, "warc-test")
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    rec = [warc_zip._page_record(i, f"http://h/{i}", b"body %d" % i, __import__("hashlib").sha1(b"body %d" % i).hexdigest(), None, False) for i in range(50)]

    def save(name, members, method=zipfile.ZIP_STORED):
        with zipfile.ZipFile(buf := io.BytesIO(), "w", method) as z:
            for n, d in members.items():
                z.writestr(n, d)
        with store.open_output_stream(f"{root}/{name}") as f:
            f.write(buf.getvalue())
        return [(f"{folder}/{name}", len(buf.getvalue()))]
    gz = b"".join(map(warc_zip._gzip, rec))
    rows = save("a.wacz", {"archive/x.warc.gz": gz, "pages/pages.jsonl": b"{}"})
    back = warc_zip.read_records(spark.createDataFrame(rows, "path string, length long")).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in back) == [(i, b"body %d" % i) for i in range(50)]
    for name, members, method in [("b.wacz", {"archive/x.warc.gz": gz}, zipfile.ZIP_DEFLATED), ("c.wacz", {"archive/x.warc.gz": gz[:-9]}, zipfile.ZIP_STORED)]:
        with pytest.raises(Exception, match="compressed in the package|is cut"):
            warc_zip.read_records(spark.createDataFrame(save(name, members, method), "path string, length long")).collect()


# --- HTML ------------------------------------------------------------------------------------------------------

def test_blocks_of_a_page_with_an_article():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>top</header><nav><li>m</nav>
      <div class="cookie-notice">we use<div>x</div></div><article><header><h1>A &amp; B</h1></header><p>one <b>two<br>three
      <p class="ad">buy<p>four&nbsp;&eacute; &#x1F600; <script>var t="</p>";</script>five<ul><li>i<li>j</ul><aside>side</aside><form>f <input></form>
      <section id="comments"><article>reader</article></section><table><tr><td>c1<td>c2</table></article><div class="sidebar">s</div><footer>end"""
    assert H.page_blocks(html) == (["A & B", "one two three", "four é 😀 five", "i", "j", "c1", "c2"], True)
    assert H.page_blocks("<main><p>x</main>y") == (["x"], True) and H.page_blocks(None) == ([], False)
    assert H.page_blocks("<div role=main>a</div><div>b</div>") == (["a"], True)
    assert H.page_blocks("plain <i>text") == (["plain text"], False)


def test_common_lines_equal_brute_force():
    rng = random.Random(4)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
            row = new
        return row[-1]
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        got = H.common_lines(a, b)
        kept = [x for x, s in zip(a, got) if s]
        assert len(kept) == longest(a, b) and longest(kept, b) == len(kept)


def test_main_text(spark):
    def page(lines):
        return "".join(f"<div>{x}</div>" for x in lines)
    shared = ["Home", "About us"]
    rows = [(1, "http://H.example/news/1.html", page([*shared, "first story", "Copyright"]), "k"), (2, "http://h.example/news/2.html", page([*shared, "second story", "Copyright"]), "k"),
            (3, "http://h.example/zzz", page(["Other menu", "third"]), "k"), (4, "http://one.example/", page([*shared, "alone"]), "k"),
            (5, "http://c.example/a", page(["copy"]), "k"), (6, "http://c.example/b", page(["copy"]), "k"), (7, None, None, "k"), (8, "", "", "k"),
            (None, "http://h.example/news/3.html", "<nav>m</nav><article>body</article>", "k"), (9, "u", "<article></article>", "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in H.main_text(df).collect()}
    assert {i: r.text for i, r in got.items()} == {1: "first story", 2: "second story", 3: "Other menu\n\nthird", 4: "Home\n\nAbout us\n\nalone", 5: "copy", 6: "copy",
                                                    7: "", 8: "", None: "body", 9: ""}
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[1].url == "http://H.example/news/1.html"
    assert H.main_text(df.limit(0)).count() == 0
    assert H.main_text(df.unionByName(df)).count() == 2 * len(rows)


def test_all_pages_of_the_table(spark):
    rows = QUERIES["op5_html_extraction"](spark, SF01).collect()
    html = {r.page_id: r.html for r in table(spark, SF01, "pages").collect()}
    assert len(rows) == len(html) and all("<" not in r.text or "&lt;" in html[r.page_id] for r in rows)
    for r in rows:  # the template's article, read by its own tags
        inner = html[r.page_id].split("<article>")[1].split("</article>")[0]
        assert r.text.count("\n\n") + 1 == sum(bool(x.split()) for x in inner.replace("</h1>", "<p>").replace("</p>", "<p>").replace("<b>", "").replace("</b>", "").replace("<br>", "").replace("<h1>", "").split("<p>"))


# --- embeddings ------------------------------------------------------------------------------------------------

def plain_links(rows, least):
    ok = [r for r in rows if r[2] is not None and r[1] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    index = {id(r): k for k, r in enumerate(rows)}
    n, left, right = [0] * len(rows), [], []
    for a in ok:
        for b in ok:
            if a is not b and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                    n[index[id(a)]] += 1
                    left.append(index[id(a)])
                    right.append(index[id(b)])
    label = forest(len(rows), np.array(left, int), np.array(right, int))
    low = {}
    for g, r in zip(label, rows):
        if r[0] is not None:
            low[g] = min(low.get(g, r[0]), r[0])
    return sorted(((r[0], k, low.get(g)) for r, k, g in zip(rows, n, label)), key=str)


@pytest.mark.parametrize("block_rows", [16, 2048])
def test_embedding_edges_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(6)
    rows = []
    for c in range(12):
        base = rng.normal(size=16)
        rows += [(100 + 20 * c + k, [float(v) for v in base + rng.normal(size=16) * 0.08 * k / 3], c % 2) for k in range(12)]
    inf, nan = float("inf"), float("nan")
    rows += [(1, None, 0), (2, [0.0] * 16, 0), (3, [1.0, None] + [0.0] * 14, 0), (4, [nan] * 16, 0), (5, [inf] + [1.0] * 15, 0), (6, [], 0),
             (7, [1.0, 2.0], 0), (8, [1.0, 2.0], 0), (9, [1.0, 2.0], None), (10, [-0.0, 2.0], 1), (11, [0.0, 2.0], 1), (None, [1.0, 2.0], 0), (8, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<float>, label int, copies string")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = pq_dedup.near_duplicates(df, reach=1.0, block_rows=block_rows).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == plain_links(rows, 0.93)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert pq_dedup.near_duplicates(df.limit(0)).count() == 0


def test_recall_on_noise_at_the_threshold(spark):
    """Links just above 0.93 in 64 dimensions, noise in all directions: the default reach finds them."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(600, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    noise = rng.normal(size=(600, 64))
    noise -= (noise * base).sum(1)[:, None] * base
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    near = 0.935 * base + np.sqrt(1 - 0.935 ** 2) * noise
    rows = [(i, [float(v) for v in x], 1) for i, x in enumerate(np.concatenate([base, near]))]
    got = pq_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = dict((i, n) for i, n, _ in plain_links(rows, 0.93))
    assert sum(r.n_links for r in got) >= 0.97 * sum(want.values()) and all(r.n_links <= want[r.vec_id] for r in got)


def unit_noise(rng, n, dim=64, near=0):
    """Unit vectors in all directions, the last ``near`` of them at cosines of 0.88 to 0.98 to the first."""
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if near:
        away = rng.normal(size=(near, dim))
        away -= (away * x[:near]).sum(1)[:, None] * x[:near]
        cosine = rng.uniform(0.88, 0.98, near)[:, None]
        x[-near:] = cosine * x[:near] + np.sqrt(1 - cosine ** 2) * away / np.linalg.norm(away, axis=1)[:, None]
    return x.astype(np.float32)


@pytest.mark.parametrize("reach", [1.0, 0.6])
def test_links_of_two_blocks_equal_brute_force(reach):
    rng = np.random.default_rng(8)
    x = unit_noise(rng, 4096, near=1200)
    x[:40] = x[0] + 0.01 * rng.normal(size=(40, 64))  # a group where all link with all
    q = pq_dedup.fit(pq_dedup.unit(x), 16 * pq_dedup.LIST_ROWS)
    assert len(q.centroids) == 16
    place = rng.permutation(len(x))

    def members(rows):
        u = pq_dedup.unit(x[rows])
        lists = q.distances(u).argmin(1)
        return pq_dedup.Members(q, lists, *q.encode(u - q.centroids[lists]), x[rows], 0.93, reach)
    u = pq_dedup.unit(x)
    want = u @ u.T >= 0.93
    np.fill_diagonal(want, False)
    copies = rng.integers(1, 4, len(x))
    for a, b in [(place, place), (place[:2048], place[2048:])]:
        ma = members(a)
        mb = ma if a is b else members(b)
        assert len(ma.lists) > 8
        linked, up, down = pq_dedup.links(ma, mb, copies[a], copies[b], 0.93)
        if a is b:
            assert linked.tolist() == (want[np.ix_(a, a)] @ copies[a]).tolist()
            some = np.argwhere(want[np.ix_(a, a)])
        else:
            across = want[np.ix_(a, b)]
            assert linked.tolist() == [*(across @ copies[b]), *(across.T @ copies[a])]
            some = np.argwhere(across) + [0, len(a)]
        assert forest(len(linked), up, down).tolist() == forest(len(linked), some[:, 0], some[:, 1]).tolist()
        met = sum(len(rows) * len(others) for rows, others, _ in pq_dedup.meeting(ma, mb))
        assert reach == 1.0 or met < 0.8 * len(a) * len(b)  # lists out of reach are not compared


def test_scratch_of_embeddings_does_not_grow_with_the_lists_probed(spark, monkeypatch):
    x = unit_noise(np.random.default_rng(9), 3000)
    df = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int").cache()
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    store, root = fs.FileSystem.from_uri(folder)

    def held():
        return sum(f.size for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file)
    before, most = held(), []
    for name in ("remove_folder", "connected_components"):  # all is written before these
        monkeypatch.setattr(pq_dedup, name, lambda *a, f=getattr(pq_dedup, name), **b: (most.append(held()), f(*a, **b))[1])
    got = pq_dedup.near_duplicates(df).collect()
    most.append(held())
    assert len(got) == len(x) and max(most) - before < 3 * x.nbytes
    df.unpersist()


def test_line_differences_run_on_pages_with_a_main_element(spark):
    story = [f"<p>Paragraph {k} of the story, which says something of its own at length.</p>" for k in range(3)]
    teaser = "<article><h2>Read on</h2></article>"
    menu = "".join(f"<div>Section {k} with a long and unmarked description of all that it has to offer</div>" for k in range(9))
    pages = [(1, "http://h/a", f"<main>{''.join(story)}{teaser}</main>"), (2, "http://h/menu/b", f"<main>{menu}<article>{story[0]}</article></main>"),
             (3, "http://h/menu/c", f"<main>{menu}<article>{story[1]}</article></main>"), (4, "http://h/d", "<article><p>shared</p><p>d</p></article>"),
             (5, "http://h/e", "<article><p>shared</p><p>e</p></article>"), (6, "http://h/f", "<div>same</div><div>own f</div>"),
             (7, "http://h/g", "<div>same</div><div>own g</div>"), (8, None, None), (9, "http://h/i", "<article></article><div>x</div>")]
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    text = [f"Paragraph {k} of the story, which says something of its own at length." for k in range(3)]
    # the story beside a teaser; the article beside a long menu, which the nearest page shares; an article's shared lines
    assert got == {1: "\n\n".join([*text, "Read on"]), 2: text[0], 3: text[1], 4: "shared\n\nd", 5: "shared\n\ne", 6: "own f", 7: "own g", 8: "", 9: ""}


def test_line_differences_decide_inside_the_main_element(spark):
    menu = "<div><a href=/x>Contents</a> <a href=/y>Archive</a></div>"
    note = "<div>You are reading our magazine</div>"
    quote = "<p>A paragraph that two stories of this host share.</p><ul><li>an item</ul>"

    def body(k):
        return f"<p>Story {k} says something of its own, and does so in full length.</p>"
    pages = [(1, "http://h/a", f"<article>{menu}{note}<h1>One</h1>{quote}{body(1)}<p><a href=/n>Next</a></p></article>"),
             (2, "http://h/b", f"<article>{menu}{note}<h1>Two</h1>{quote}{body(2)}<p><a href=/n>Next</a></p></article>"),
             (3, "http://m/a", f"<main>{menu}{note}{quote}{body(3)}</main>"), (4, "http://m/b", f"<main>{menu}{note}{quote}{body(4)}<div>in a box</div></main>"),
             (5, "http://c/a", f"<article>{menu}{note}</article>"), (6, "http://c/b", f"<article>{menu}{note}</article>"),
             (7, "http://v/a", "<main><div>A long first part of one text in two versions</div><div>v1</div></main>"),
             (8, "http://v/b", "<main><div>A long first part of one text in two versions</div><div>v2</div></main>"),
             (9, "http://s/a", f"<article>{menu}{note}{body(9)}</article>")]
    got = {r.page_id: r.text.split("\n\n") for r in H.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    shared = ["A paragraph that two stories of this host share.", "an item"]
    story = {k: f"Story {k} says something of its own, and does so in full length." for k in (1, 2, 3, 4, 9)}
    template = ["Contents Archive", "You are reading our magazine"]
    assert got == {1: ["One", *shared, story[1]], 2: ["Two", *shared, story[2]], 3: [*shared, story[3]], 4: [*shared, story[4], "in a box"], 5: template, 6: template,
                   7: ["A long first part of one text in two versions", "v1"], 8: ["A long first part of one text in two versions", "v2"], 9: [*template, story[9]]}
