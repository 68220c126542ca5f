from __future__ import annotations

import datetime
import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from postlake.sources import boards as B, demo, export, markup as M, notify, snapshots


def listing(spark, body, source="s"):
    return spark.createDataFrame([(source, json.dumps(body))], "source_id string, body string")


def test_greenhouse_skips_what_breaks_the_contract(spark):
    body = {"jobs": [{"id": 1, "title": "Dev", "updated_at": "2024-01-02T00:00:00Z", "location": {"name": "Rome"}, "absolute_url": "https://x.io/1?gh_src=a", "departments": [{"id": 2, "name": "Core"}], "content": "&lt;p&gt;Hi&lt;/p&gt;"}, {"id": 2, "title": " ", "absolute_url": "https://x.io/2"}]}
    good, bad = B.split_valid(B.greenhouse(listing(spark, body)))
    row = good.collect()
    assert [r.external_id for r in row] == ["1"] and row[0].department == "Core" and row[0].location == "Rome"
    assert [r.external_id for r in bad.collect()] == ["2"]


def test_a_listing_without_its_list_is_an_error(spark):
    with pytest.raises(Exception, match="no list of postings"):
        B.greenhouse(listing(spark, {"meta": {}})).collect()


def test_ashby_leaves_unlisted_out(spark):
    body = {"jobs": [{"id": "a", "title": "T", "isListed": False, "jobUrl": "https://x.io/a"}, {"id": "b", "title": "T", "location": "Rome", "secondaryLocations": [{"location": "Oslo"}], "isRemote": True, "workplaceType": "Hybrid", "jobUrl": "https://x.io/b"}]}
    row = B.ashby(listing(spark, body)).collect()
    assert [(r.external_id, r.location, r.remote_hint) for r in row] == [("b", "Rome, Oslo", None)]


def test_generic_needs_its_paths(spark):
    with pytest.raises(ValueError, match="external_id"):
        B.generic(listing(spark, {}), {"items": "a", "title": "t", "url": "u"}, "https://x.io")
    body = {"data": {"items": [{"uid": 7, "name": "T", "link": "jobs/7", "remote": True}]}}
    row = B.generic(listing(spark, body), {"items": "data.items", "external_id": "uid", "title": "name", "url": "link", "remote_hint": "remote"}, "https://x.io/board/list").first()
    assert (row.external_id, row.url, row.remote_hint) == ("7", "https://x.io/board/jobs/7", True)


def test_feed(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>Dev</title><link>https://x.io/1?utm_source=a</link><guid>g1</guid><description>Hi</description><pubDate>Mon, 03 Jun 2024 10:00:00 +0000</pubDate></item></channel></rss>")
    row = B.read_feed(spark, str(tmp_path / "feed.xml"), "rss1").select("external_id", "title", "url", F.unix_seconds("published_at").alias("at")).first()
    assert tuple(row) == ("g1", "Dev", "https://x.io/1?utm_source=a", 1717408800)


def test_html_is_sanitised():
    dirty = '<p onclick="x()">Hi <script>alert(1)</script><a href="javascript:x" title="t">a</a> <a href="https://x.io">b</a><!-- c --></p>'
    assert M.sanitize(dirty) == '<p>Hi <a title="t">a</a> <a href="https://x.io" rel="noopener noreferrer nofollow">b</a></p>'
    assert M.sanitize("&lt;b&gt;x&lt;/b&gt;") == "<b>x</b>"


def test_html_as_text():
    assert M.to_text("<h1>A</h1><p>b  &amp;\tc</p><style>x</style><ul><li>d</li><li>e</li></ul>") == "A\n\nb & c\n\nd\n\ne"


#: Pages whose titles end within a reference, as in the tables, one of more than 500,000 characters, one that begins in a wide space.
CUT = [f"<h1>token = {'&quot;x&amp;y&lt;&gt;&copy;&middot;'[:n]}</h1><p>R&amp;D &copy2 &notit; &quotx; x&ampy</p>" for n in range(40)] + ["<p>" + "x &amp; y " * 60_000 + "</p><p>end</p>", "<p>\u3000a</p>", None]


def _as_in_sql(name: str, made) -> None:
    import duckdb

    from postlake.plans.registry import ORACLES

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id INT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(CUT)))
    want = dict(con.execute(ORACLES[name]).fetchall())
    assert [want[i] for i in range(len(CUT))] == [x and made(x) for x in CUT]


def test_sanitised_html_of_cut_references_and_long_pages_as_in_sql():
    _as_in_sql("E01_sanitize_html", M.sanitize)


def test_text_of_cut_references_and_long_pages_as_in_sql():
    _as_in_sql("E02_html_to_text", M.to_text)


def test_html_listing(spark):
    page = '<ul><li class="job"><a class="t" href="/1">Dev</a><span class="loc"> Rome </span></li><li class="job"><b>none</b></li><li class="job"><a class="t" href="https://y.io/2">Ops</a></li></ul>'
    df = spark.createDataFrame([("https://x.io/list", page)], "url string, html string")
    rows = M.html_listing(df, "li.job", {"title": "a.t", "location": ".loc"}).orderBy("position").collect()
    assert [(r.title, r.url, r.location) for r in rows] == [("Dev", "https://x.io/1", "Rome"), (None, None, None), ("Ops", "https://y.io/2", None)]
    assert rows[0].external_id == hashlib.sha256(b"https://x.io/1").hexdigest()[:32] and rows[1].external_id is None


def test_listing_ids_outlive_tracking_parameters(spark):
    page = '<ul><li class="job"><a href="{}">Dev</a></li></ul>'
    df = spark.createDataFrame([("https://x.io/l", page.format(u)) for u in ("/1?utm_source=a", "https://www.x.io/1/", "/1")], "url string, html string")
    assert len({r.external_id for r in M.html_listing(df, "li.job", {"title": "a"}).collect()}) == 1


def test_demo_board_releases_little_by_little(spark, tmp_path):
    spark.dataSource.register(demo.DemoSource)
    stream = spark.readStream.format("demo_board").option("size", "8").load()
    query = stream.writeStream.format("memory").queryName("demo_rows").option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
    query.awaitTermination(60)
    ids = [r.external_id for r in spark.table("demo_rows").orderBy("released").collect()]
    assert ids[:6] == [f"demo-{i}" for i in range(6)]
    assert demo.posting_id(9, 8) == "demo-1-r1"
    assert demo.visible(spark, 11).count() == 30


@pytest.mark.parametrize(("polls", "first", "end"), [(1, 0, 6), (2, 0, 9), (11, 6, 36)])
def test_demo_board_lists_what_is_open(spark, polls, first, end):
    spark.dataSource.register(demo.DemoSource)
    rows = spark.read.format("demo_board").option("polls", str(polls)).load().orderBy("released").collect()
    assert [r.released for r in rows] == list(range(first, end))
    assert {r.external_id for r in rows} == {r.external_id for r in demo.visible(spark, polls).collect()}


def test_signature(spark):
    got = spark.range(1).select(notify.signature("k", F.lit(5), F.lit("body"))).first()[0]
    assert got == hmac.new(b"k", b"5.body", hashlib.sha256).hexdigest()


def test_outbox_adds_each_key_once(spark, tmp_path):
    write = notify.outbox_sink(str(tmp_path / "outbox"))
    batch = spark.createDataFrame([("a",), ("a",), ("b",)], "key string")
    write(batch, 0)
    write(batch.union(spark.createDataFrame([("c",)], "key string")), 1)
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "outbox")).collect()) == ["a", "b", "c"]


def test_snapshots_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("s", "x"), ("s", "x"), ("../t", "y")], "source string, body string")
    folder = str(tmp_path / "snap")
    index = snapshots.write_snapshots(rows, folder)
    assert index.count() == 2 and index.where(~snapshots.valid_key(F.col("key"))).count() == 0
    more = snapshots.write_snapshots(rows.union(spark.createDataFrame([("s", "z")], rows.schema)), folder, index)
    assert more.count() == 3


def test_export_by_parts(spark):
    w = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, name string")
    jobs = spark.createDataFrame([(1, f"job {i}") for i in range(95)] + [(2, "y"), (2, "y"), (9, "nobody's")], "id int, job string")
    sites = spark.createDataFrame([(2, "x, [y]")], "id int, site string")
    parts = export.export_parts(w, {"jobs": jobs, "sites": sites}, "id", part_rows=10).collect()
    assert max(r.rows for r in parts) < 40 and len({r.part for r in parts if r.id == 1 and r.name == "jobs"}) == 10
    docs = {i: json.loads(export.document([(r.section, r.name, r.part, r.fragment) for r in parts if r.id == i])) for i in (1, 2, 3)}
    assert sorted(x["job"] for x in docs[1]["jobs"]) == sorted(f"job {i}" for i in range(95)) and docs[1]["workspace"] == {"id": 1, "name": "a"}
    assert docs[2] == {"workspace": {"id": 2, "name": "b"}, "jobs": [{"job": "y"}] * 2, "sites": [{"site": "x, [y]"}]}
    assert docs[3] == {"workspace": {"id": 3}, "jobs": [], "sites": []}
    assert {r.id for r in parts} == {1, 2, 3}


def test_a_store_keeps_bodies_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_BYTES", 40)
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"), buckets=4)
    schema = "target string, stamp timestamp, status int, etag string, last_modified string, body binary"
    at = datetime.datetime(2024, 6, 1)
    row = lambda target, etag, modified, body, status=200: (target, at, status, etag, modified, None if body is None else bytearray(body))

    def fetch(batch, *rows):
        return {r.target: r.outcome for r in store.fetched(spark.createDataFrame(rows, schema), batch).collect()}

    first = [row("a", '"1"', None, b"one"), row("b", None, "Mon", b"two"), row("c", None, None, b"one"), row("big", None, None, b"x" * 41), row("near", None, None, b"y" * 31), row("none", None, None, None)]
    assert fetch(0, *first) == {"a": "stored", "b": "stored", "c": "stored", "big": "too_large", "near": "stored", "none": "empty"}
    assert store.bodies().count() == 3
    again = {"a": "not_modified", "b": "not_modified", "c": "known", "big": "too_large", "near": "known", "none": "empty"}
    assert fetch(1, *first) == again and store.bodies().count() == 3  # a second run stores nothing
    assert fetch(1, *first) == again  # nor does a batch that comes again
    later = fetch(2, row("a", '"2"', None, b"one"), row("b", None, "Tue", b"three"), row("d", None, None, b"two", 304), row("near", '"n"', None, b"y" * 31))
    assert later == {"a": "known", "b": "stored", "d": "not_modified", "near": "known"} and store.bodies().count() == 4
    told = {r.target: (r.etag, r.last_modified) for r in store.validators(spark.createDataFrame([("a",), ("b",), ("x",)], "target string"), 3).collect()}
    assert told == {"a": ('"2"', None), "b": (None, "Tue")}
    near = spark.read.parquet(str(tmp_path / "store/manifests")).where("batch = 0 AND near_limit").collect()
    assert {r.target for r in near} == {"big", "near"}


def test_keys_of_postings(spark):
    key = snapshots.posting_key(F.lit("lever"), F.lit("a.io"), F.lit("../7"), F.lit(datetime.datetime(2024, 6, 1, 2, 3, 4)))
    got = spark.range(1).select(key.alias("k")).select("k", snapshots.valid_key(F.col("k"))).first()
    assert got[0].startswith("raw/lever/a.io/") and got[0].endswith("/20240601T020304Z.json") and got[1]


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("li", ["1", "2", "3", "4"]), ("ul > li", ["1", "2", "3", "4"]), ("ul.x > li", ["1", "2"]), ("div li.job.hot", ["2"]), ("#main li", ["1", "2"]), ("li[data-k]", ["1", "3"]), ('li[data-k="a b"]', ["1"]), ("li[data-k~=b]", ["1"]),
        ("li[data-k^='z']", ["3"]), ("li[data-k$=z], li[data-k*=' ']", ["1", "3"]), ("body > li", []), ("div > ul li.job, ol *", ["2", "3", "4"]), ("section li", []), ("ol > *.job", ["4"]), ("UL LI", ["1", "2", "3", "4"]), ("div[title='a,b'] li", ["1", "2"]),
    ],
)
def test_selectors(selector, want):
    page = "<body><div id=main title='a,b'><ul class='x y'><li data-k='a b'><a href=1>t</a><li class='job hot'><a href=2>t</a></ul></div><ul><ol><li data-k=zz><a href=3>t</a></li><li class=job><a href=4>t</a></li></ol></ul></body>"
    page = page.replace("</a><li", "</a></li><li").replace("</a></ul>", "</a></li></ul>").replace("<ul><ol>", "<ol>").replace("</ol></ul>", "</ol>")
    if selector in ("ul > li", "UL LI"):
        page = page.replace("<ol>", "<ul>").replace("</ol>", "</ul>")
    p = M._Select(selector, {"title": "a"})
    p.feed(page)
    assert [r.get("link") for r in p.rows if "link" in r] == want


@pytest.mark.parametrize("selector", ["", "a >", "> a", "a:hover", "a[", "a,", "a b >", "a + b", "[x=]"])
def test_selectors_that_arent_understood(selector):
    with pytest.raises(ValueError):
        M.compile_selector(selector)


def test_items_in_items_and_departments(spark):
    page = "<div class=g><h2>Core</h2><div class=g><h2>Inner</h2><a class=t href=/1>Dev</a><i class=d>R&amp;D</i></div><a href=/2>Ops</a></div>"
    rows = M.html_listing(spark.createDataFrame([("https://x.io/", page)], "url string, html string"), "div.g", {"title": "h2", "department": "div > i.d", "link": "a[href]"}).orderBy("position").collect()
    assert [(r.title, r.url, r.department) for r in rows] == [("Core", "https://x.io/1", "R&D"), ("Inner", "https://x.io/1", "R&D")]


def test_boards_of_all_kinds_at_once(spark):
    rows = [
        ("g", "greenhouse", '{"jobs": [{"id": 1, "title": "A", "absolute_url": "https://x/1"}, {"id": 2, "title": "", "absolute_url": "https://x/2"}]}'), ("l", "lever", '[{"id": "7", "text": "B", "hostedUrl": "https://x/7"}]'),
        ("a", "ashby", '{"jobs": []}'), ("r", "rss", "<rss><channel><item><title>C</title><guid>g</guid><link>https://x/c</link></item></channel></rss>"), ("j", "generic_json", '{"data": {"items": [{"uid": 5, "title": "D", "url": "/d"}]}}'),
        ("bad1", "lever", "{}"), ("bad2", "greenhouse", "<html>"), ("bad3", "fax", "x"), ("bad4", "rss", None), ("bad5", None, "x"), ("bad6", "rss", "no feed"),
    ]
    good, bad = B.read_boards(spark.createDataFrame(rows, "source_id string, kind string, body string"), base="https://b.io/x")
    assert {(r.source_id, r.external_id, r.title, r.url) for r in good.collect()} == {("g", "1", "A", "https://x/1"), ("l", "7", "B", "https://x/7"), ("r", "g", "C", "https://x/c"), ("j", "5", "D", "https://b.io/d")}
    assert {(r.source_id, r.reason) for r in bad.collect()} == {("g", "posting"), ("bad1", "unreadable"), ("bad2", "unreadable"), ("bad3", "kind"), ("bad4", "missing"), ("bad5", "kind"), ("bad6", "unreadable")}


def test_boards_that_go_round(spark):
    board = spark.createDataFrame([("s", f"e{i}", p) for p in (1, 11) for i in range(8)], "source_id string, external_id string, polls int")
    for polls in (1, 11):
        got = demo.released(board.where(F.col("polls") == polls), F.col("polls")).collect()
        end = 6 + 3 * (polls - 1)
        assert sorted((r.external_id, r.round, r.minutes_ago) for r in got) == sorted((f"e{n % 8}", n // 8, (end - 1 - n) * 7) for n in range(max(0, end - 30), end))


def test_policies_of_rows(spark):
    from postlake.sources.policy import read_policies

    texts = ['{"experience_min": 1}', "[1]", '{"nope": 1}', '{"experience_min": 9.0}', "{" + " " * 70_000 + "}", None, '{"allowed_locations": 5}', "{}", '{"experience_tolerance_years": null}']
    rows = read_policies(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, policy string")).orderBy("i").collect()
    assert [r.problem for r in rows] == [None, "unreadable", "unknown", "range", "long", "unreadable", "unreadable", None, "unreadable"]
    assert rows[0].experience_min == 1.0 and rows[0].allowed_work_models == ["remote"] and rows[1].experience_max is None


def test_policies(spark):
    from postlake.sources.policy import load_policy, load_sources

    assert load_policy('{"experience_min": 1.0}').experience_min == 1.0
    for text in ("[1]", '{"nope": 1}', '{"experience_min": 9.0}', "{" + " " * 70_000 + "}"):
        with pytest.raises(ValueError):
            load_policy(text)
    seeds = load_sources(spark, '{"sources": [{"kind": "lever", "token": "a"}, {"kind": "lever", "token": "a"}, {"kind": "rss"}]}')
    good, bad = B.split_definitions(seeds)
    assert good.count() == 1 and bad.count() == 1
    with pytest.raises(ValueError):
        B.postings_of("nope", seeds)


def test_bodies_are_shuffled_once(spark, tmp_path):
    def shuffled() -> int:
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    rng = random.Random(1)
    bodies = [rng.randbytes(100_000) for _ in range(40)]
    at = datetime.datetime(2024, 6, 1)
    rows = [(str(i), at, 200, None, None, bytearray(x)) for i, x in enumerate([*bodies, *bodies[:5], b"twice"])] + [("45", at, 200, None, None, bytearray(b"twice"))]
    fetches = spark.createDataFrame(rows, "target string, stamp timestamp, status int, etag string, last_modified string, body binary")
    store, before = snapshots.SnapshotStore(spark, str(tmp_path / "store"), buckets=4), shuffled()
    assert {r.outcome for r in store.fetched(fetches, 0).collect()} == {"stored"}
    assert sorted(bytes(r.body) for r in store.bodies().collect()) == sorted([*bodies, b"twice"])
    assert shuffled() - before < 1.5 * sum(map(len, bodies))
