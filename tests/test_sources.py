"""Sources that read from servers and file trees, against fake servers that keep a log."""

import io
import json
import re
import threading
import zipfile
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse

import pytest
from pyspark.sql import functions as F

from cargolens.operators import hub
from cargolens.plans.audit import audit_hub_online
from cargolens.sources import hub_listing, remote_members, remote_zip, web
from tests import fixtures


class Server:
    """Files by path, read by ranges, and answers by path; every request is logged."""

    def __init__(self):
        self.files, self.answers, self.log, self.fail = {}, {}, [], Counter()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            protocol_version = "HTTP/1.1"

            def log_message(self, *_):
                pass

            def _send(self, code, body=b"", headers=None, length=None):
                self.send_response(code)
                for k, v in (headers or {}).items():
                    self.send_header(k, v)
                self.send_header("Content-Length", str(len(body) if length is None else length))
                self.end_headers()
                if self.command != "HEAD":
                    self.wfile.write(body)

            def do_GET(self):
                outer.log.append((self.command, self.path, self.headers.get("Range")))
                if outer.fail[self.path] > 0:
                    outer.fail[self.path] -= 1
                    self._send(503, b"later", {"Retry-After": "0"})
                    return
                path = unquote(urlparse(self.path).path)
                if path in outer.files:
                    data = outer.files[path]
                    if self.command == "HEAD":
                        self._send(200, length=len(data))
                    elif m := re.fullmatch(r"bytes=(\d+)-(\d+)", self.headers.get("Range") or ""):
                        self._send(206, data[int(m[1]) : int(m[2]) + 1])
                    else:
                        self._send(200, data)
                    return
                for prefix, answer in outer.answers.items():
                    if path == prefix or (prefix.endswith("*") and path.startswith(prefix[:-1])):
                        found = answer(path, parse_qs(urlparse(self.path).query))
                        if found is not None:
                            self._send(200, json.dumps(found[0]).encode(), found[1])
                            return
                self._send(404, b"no")

            do_HEAD = do_GET

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.http.server_port}"
        threading.Thread(target=self.http.serve_forever, daemon=True).start()

    def spans(self, path):
        return [r for m, p, r in self.log if p == path and m == "GET"]


@pytest.fixture
def server():
    s = Server()
    yield s
    s.http.shutdown()
    s.http.server_close()


def archive(members, method=zipfile.ZIP_DEFLATED, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members:
            z.writestr(name, data)
        z.comment = comment
    return out.getvalue()


def test_two_members_are_tail_and_two_ranges(spark, server):
    import random

    noise = lambda k: random.Random(k).randbytes(300_000)
    members = [(f"m/data/{k}", noise(k)) for k in range(20)]
    members[3] = ("m/data.pkl", fixtures.ECHO)
    members[15] = ("m/extra.pkl", fixtures.state())
    server.files["/w.bin"] = archive(members, zipfile.ZIP_STORED)
    df = remote_members.remote_members(spark, [("t", "w.bin", server.url + "/w.bin")])
    got = {r.member: bytes(r.content) for r in df.where("member in ('m/data.pkl', 'm/extra.pkl')").select("member", "content").collect()}
    assert got == {"m/data.pkl": fixtures.ECHO, "m/extra.pkl": fixtures.state()}
    spans = server.spans("/w.bin")
    whole = len(server.files["/w.bin"])
    # the tail holds the directory; then one range a member
    assert len(spans) == 3 and [m for m, _, _ in server.log].count("HEAD") == 1
    read = sum(int(b) - int(a) + 1 for a, b in (s.removeprefix("bytes=").split("-") for s in spans))
    assert read < remote_zip.TAIL_BYTES + 4096 < whole // 50
    server.log.clear()
    assert df.where(F.col("member").endswith(".pkl") & (F.col("size") < 10_000) & (F.col("target_id") == "t")).count() == 2
    assert df.where("target_id = 'u'").count() == 0 and df.where("not member = 'm/data.pkl' and ord = 4").count() == 1


def test_without_content_only_directories_are_read(spark, server):
    for k in range(5):
        server.files[f"/{k}.zip"] = archive([(f"a{i}.txt", b"x" * 100_000) for i in range(4)])
    files = [("t", f"{k}.zip", f"{server.url}/{k}.zip") for k in range(5)]
    rows = remote_members.remote_members(spark, files, "path string, member string, size long").where("path <> '3.zip'").collect()
    assert sorted((r.path, r.member, r["size"]) for r in rows) == sorted((f"{k}.zip", f"a{i}.txt", 100_000) for k in (0, 1, 2, 4) for i in range(4))
    assert all(len(server.spans(f"/{k}.zip")) == 1 for k in (0, 1, 2, 4)) and not server.spans("/3.zip")


def test_planned_and_unplanned_archives_are_the_same(spark, server):
    for k in range(6):
        server.files[f"/{k}.zip"] = archive([(f"a{i}.txt", bytes([i]) * 50_000) for i in range(k + 1)], comment=b"c" * k)
    server.files["/odd.zip"] = b"no archive"
    server.files["/cut.zip"] = server.files["/5.zip"][:-400] + server.files["/5.zip"][-400:].replace(b"a5.txt", b"a6.txt")
    server.fail["/2.zip"] = 1
    files = [("t", n, f"{server.url}/{n}") for n in [*(f"{k}.zip" for k in range(6)), "odd.zip", "gone.zip"]]
    key = lambda r: (r.path, r.ord if r.ord is not None else -1, r.member, None if r.content is None else bytes(r.content), r.error)
    one = sorted(map(key, remote_members.remote_members(spark, files).collect()))
    two = sorted(map(key, remote_members.remote_members(spark, files, plannedFiles=0).collect()))
    three = sorted(map(key, remote_members.remote_members(spark, files, partitionBytes=1, requestsPerSecond=1000).collect()))
    assert one == two == three and len(one) == 23
    assert {r[0] for r in one if r[4]} == {"odd.zip", "gone.zip"} and "404" in [r[4] for r in one if r[0] == "gone.zip"][0]
    with pytest.raises(Exception, match="404"):
        remote_members.remote_members(spark, files, errors="raise").where("member = 'a0.txt'").collect()


def test_filters_follow_sql(spark, server):
    server.files["/a.zip"] = archive([("a.txt", b"1"), ("b.pkl", b"22"), ("c", b"")])
    df = remote_members.remote_members(spark, [("t", "a.zip", server.url + "/a.zip"), (None or "u", "gone.zip", server.url + "/gone.zip")])
    rows = df.collect()
    local = spark.createDataFrame(rows, df.schema)
    for condition in ("member is null", "member is not null", "not (member = 'c')", "member in ('c', null)", "not member in ('c', 'x')", "member <=> null", "size >= 1 and size < 2", "size <= 0 or ord = 1", "member like '%.pkl'", "member like 'a%'", "member like '%.%'", "not member like '%.%'", "error is null", "content is not null", "length(content) > 1"):
        assert sorted(map(str, df.where(condition).collect())) == sorted(map(str, local.where(condition).collect())), condition


def test_budget_spaces_requests():
    import time

    b, at = web.Budget(50), time.monotonic()
    for _ in range(6):
        b.spend()
    assert time.monotonic() - at >= 0.09
    assert web.Budget(None).gap == 0


# --- hub -------------------------------------------------------------------------------------------


def info(k):
    return {"id": f"org{k % 7}/m{k}", "author": f"org{k % 7}", "downloads": k, "likes": None, "createdAt": "2024-01-01T00:00:00.000Z", "gated": "auto" if k % 2 else False, "disabled": False, "tags": ["x", 3], "siblings": [{"rfilename": "model.bin", "size": 5, "lfs": {"a": 1}}, {"rfilename": "config.json"}, "odd"]}


def pages(server, total, size):
    """The listing by cursor, of all or of an author."""

    def answer(path, query):
        author = query.get("author", [None])[0]
        mine = [k for k in range(total) if author in (None, f"org{k % 7}")]
        at = int(query.get("cursor", ["0"])[0])
        more = {"Link": f'<{server.url}/api/models?cursor={at + size}&limit={size}' + (f"&author={author}" if author else "") + '>; rel="next"'} if at + size < len(mine) else {}
        return [info(k) for k in mine[at : at + size]], more

    server.answers["/api/models"] = answer


def test_ids_and_authors(spark, server):
    pages(server, 50, 4)
    server.answers["/api/models/*"] = lambda path, _: (info(int(path.rsplit("m", 1)[1])), {}) if "gone" not in path else None
    df = hub_listing.repositories(spark, ["org1/m1", "org2/gone"], ["org3", "nobody"], endpoint=server.url, pageSize=4, requestsPerSecond=500)
    got = df.collect()
    assert sorted(r.id for r in got if not r.error) == sorted(["org1/m1"] + [f"org3/m{k}" for k in range(50) if k % 7 == 3])
    assert [(r.id, "404" in r.error) for r in got if r.error] == [("org2/gone", True)]
    one = next(r for r in got if r.id == "org1/m1")
    assert (one.gated, one.tags, one.likes, [(s.rfilename, s["size"], s.lfs) for s in one.siblings]) == ("auto", ["x"], None, [("model.bin", 5, True), ("config.json", None, False)])
    assert df.columns[:-1] == [c.split(" ")[0] for c in hub.REPOS.split(", ")]
    with pytest.raises(Exception, match="ids or authors"):
        hub_listing.repositories(spark).collect()


def test_listing_streams_every_page_once(spark, server, tmp_path):
    """10,000 repositories in 100 pages: one page fails for a while and ends the query; a restart reads it again, and no row comes twice."""
    pages(server, 10_000, 100)
    lost = "/api/models?cursor=4200&limit=100"
    server.fail[lost] = 10**6

    def run():
        q = hub_listing.listing(spark, endpoint=server.url, pageSize=100, pagesPerBatch=15).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="503"):
        run()
    some = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < some.count() <= 4200
    server.fail[lost] = 1
    server.log.clear()
    run()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("id").distinct().count() == 10_000
    assert not any("cursor=100&" in p for _, p, _ in server.log) and sum(lost in p for _, p, _ in server.log) >= 2


def test_ids_to_verdicts_in_one_call(spark, server):
    files = {"bad/m": {"w.bin": fixtures.torch_zip(fixtures.ECHO), "config.json": b'{"auto_map": {"AutoModel": "m.Own"}}'}, "good/m": {"w.bin": fixtures.torch_zip(fixtures.state()), "README.md": b"x", "model.safetensors": fixtures.SAFE}, "odd/m": {"config.json": b"{no", "w.pt": b"plain"}}
    many = {f"{k}.bin": fixtures.torch_zip(fixtures.ECHO if k == 6 else fixtures.state()) for k in range(8)}
    files["many/m"] = many
    for repo, listed in files.items():
        for name, data in listed.items():
            server.files[f"/{repo}/resolve/main/{name}"] = data

    def metadata(path, _):
        repo = path.removeprefix("/api/models/")
        if repo not in files:
            return None
        return {"id": repo, "author": repo.split("/")[0], "downloads": 10**6, "likes": 100, "createdAt": "2020-01-01T00:00:00Z", "siblings": [{"rfilename": n, "size": len(d)} for n, d in files[repo].items()]}, {}

    server.answers["/api/models/*"] = metadata
    a = audit_hub_online(spark, [*files, "gone/m"], endpoint=server.url)
    verdicts = {r.target_id: r for r in a.verdicts.collect()}
    fired = {(r.target_id, r.rule_id) for r in a.findings.collect()}
    assert {("bad/m", "PKL-001"), ("bad/m", "CFG-001"), ("bad/m", "REPO-001"), ("good/m", "FMT-001")} <= fired and ("good/m", "REPO-001") not in fired
    assert verdicts["bad/m"].verdict == "BLOCK" and verdicts["good/m"].verdict == "ALLOW"
    # the first six weight files in the order of the listing are read, and of each the tail and one member
    assert ("many/m", "PKL-001") not in fired and not server.spans("/many/m/resolve/main/6.bin") and server.spans("/many/m/resolve/main/5.bin")
    assert {(r.target_id, r.path) for r in a.errors.collect()} == {("gone/m", "")} and verdicts["gone/m"].exit_code in (1, 3)
    a.release()


# --- listing by rounds -----------------------------------------------------------------------------


def test_listing_by_rounds_equals_a_walk(spark, tmp_path):
    import os

    from cargolens.sources import tree

    deep = tmp_path / "deep"
    for k in range(60):
        folder = deep / f"d{k % 7}" / f"e{k}" / ("x/" * (k % 5))
        folder.mkdir(parents=True)
        for i in range(k % 9):
            (folder / f".f{i}").write_bytes(b"x" * i)
    (deep / ".git").mkdir()
    (deep / ".git" / "hidden").write_bytes(b"x")
    os.symlink(deep / "d1", deep / "link")
    os.symlink("nowhere", deep / "broken")
    os.symlink(deep / "d1" / "e1", deep / "d2" / "again")
    with open(os.fsencode(str(deep)) + b"/odd\xff.txt", "wb") as f:
        f.write(b"x")
    (tmp_path / "one.bin").write_bytes(b"123")
    (tmp_path / "empty").mkdir()
    roots = [str(deep), str(tmp_path / "one.bin"), str(tmp_path / "empty")]
    want = sorted((tree._shown(r), tree._shown(path), repo, size, os.fsencode(full)) for r in roots for full, path, repo, size in tree.walk(r))
    for share in (1, 10, 2000):
        assert sorted((r.target_id, r.path, r.is_repo, r["size"], bytes(r.uri)) for r in tree.listing(spark, roots, share).collect()) == want, share
    assert tree.listing(spark, []).count() == 0


def test_one_large_root_is_listed_by_many_tasks(spark, tmp_path):
    """One root of 20,000 files in 500 folders."""
    from cargolens.sources import tree

    for k in range(500):
        (tmp_path / f"d{k}").mkdir()
        for i in range(40):
            (tmp_path / f"d{k}" / f"f{i}").touch()
    rows = tree.listing(spark, [str(tmp_path)], 400)
    per = rows.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in per) == 20_000 and len(per) > 50
