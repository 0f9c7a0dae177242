"""REST surface, jobs, paging and the shell."""

import io
import json
import threading
import time
import urllib.request

import pytest

from sparkloom.api import Api, serve
from sparkloom.repl import Repl


@pytest.fixture()
def api(engine):
    return Api(engine)


def call(api, method, path, body=None, **query):
    return api.handle(method, path, {k: str(v) for k, v in query.items()}, body or {})


def run(api, sql, **body):
    return call(api, "POST", "/prefix/v2/projects/project1/queries", {"query": sql, **body})


def test_datasets_and_tables(api):
    p = "/prefix/v2/projects/project1/datasets"
    assert call(api, "POST", p, {"datasetReference": {"datasetId": "d1"}, "labels": {"a": "b"}})[0] == 200
    assert call(api, "POST", p, {"datasetReference": {"datasetId": "d1"}})[0] == 409
    assert call(api, "GET", f"{p}/d1")[1]["labels"] == {"a": "b"} and call(api, "GET", f"{p}/zz")[0] == 404
    assert call(api, "PATCH", f"{p}/d1", {"description": "x"})[1]["labels"] == {"a": "b"}
    assert "labels" not in call(api, "PUT", f"{p}/d1", {"description": "y"})[1]
    assert [d["datasetReference"]["datasetId"] for d in call(api, "GET", p)[1]["datasets"]] == ["d1"]
    fields = [{"name": "id", "type": "INTEGER", "mode": "REQUIRED"}, {"name": "name", "type": "STRING"}]
    assert call(api, "POST", f"{p}/d1/tables", {"tableReference": {"tableId": "t"}, "schema": {"fields": fields}})[0] == 200
    got = call(api, "GET", f"{p}/d1/tables/t")[1]
    assert [(f["name"], f["type"], f["mode"]) for f in got["schema"]["fields"]] == [("id", "INTEGER", "REQUIRED"), ("name", "STRING", "NULLABLE")]
    assert call(api, "POST", f"{p}/d1/tables/t/insertAll", {"rows": [{"json": {"id": i, "name": "n"}} for i in range(5)]})[1] == {"kind": "tableDataInsertAllResponse"}
    assert call(api, "POST", f"{p}/d1/tables/t/insertAll", {"rows": [{"json": {"name": "n"}}]})[1]["insertErrors"][0]["index"] == 0
    page = call(api, "GET", f"{p}/d1/tables/t/data", maxResults=2)[1]
    assert len(page["rows"]) == 2 and page["totalRows"] == "5" and page["pageToken"] == "2"
    assert len(call(api, "PATCH", f"{p}/d1/tables/t", {"schema": {"fields": [*fields, {"name": "x", "type": "FLOAT"}]}})[1]["schema"]["fields"]) == 3
    assert call(api, "PATCH", f"{p}/d1/tables/t", {"schema": {"fields": fields[:1]}})[0] == 400
    assert call(api, "POST", f"{p}/d1/tables", {"tableReference": {"tableId": "v"}, "view": {"query": "SELECT id FROM d1.t"}})[1]["type"] == "VIEW"
    assert [t["tableReference"]["tableId"] for t in call(api, "GET", f"{p}/d1/tables")[1]["tables"]] == ["t", "v"]
    assert call(api, "DELETE", f"{p}/d1/tables/t")[0] == 204 and call(api, "DELETE", f"{p}/d1/tables/t")[0] == 404
    assert call(api, "DELETE", f"{p}/d1")[0] == 204 and call(api, "GET", f"{p}/d1")[0] == 404
    assert [x["id"] for x in call(api, "GET", "/projects")[1]["projects"]] == []


def test_queries_jobs_and_paging(api):
    status, out = run(api, "SELECT x FROM UNNEST(GENERATE_ARRAY(1, 25)) AS x ORDER BY x", maxResults=10)
    assert status == 200 and out["jobComplete"] and out["totalRows"] == "25" and len(out["rows"]) == 10 and out["schema"]["fields"][0]["type"] == "INTEGER"
    job, seen = out["jobReference"]["jobId"], [r["f"][0]["v"] for r in out["rows"]]
    while out.get("pageToken"):
        out = call(api, "GET", f"/projects/project1/queries/{job}", maxResults=10, pageToken=out["pageToken"])[1]
        seen += [r["f"][0]["v"] for r in out["rows"]]
    assert seen == [str(i) for i in range(1, 26)]
    assert call(api, "GET", f"/projects/project1/jobs/{job}")[1]["status"]["state"] == "DONE"
    assert run(api, "SELECT nope")[0] == 400 and run(api, "SELECT * FROM d.t")[0] == 404
    assert run(api, "SELECT 1 AS a", dryRun=True)[1]["schema"]["fields"][0]["name"] == "a"
    status, out = run(api, "CREATE SCHEMA d; CREATE TABLE d.t AS SELECT 1 AS a; INSERT INTO d.t VALUES (2), (3)")
    assert status == 200 and out["numDmlAffectedRows"] == "2"
    params = [{"name": "p", "parameterType": {"type": "INT64"}, "parameterValue": {"value": "7"}}]
    assert run(api, "SELECT @p AS p", queryParameters=params)[1]["rows"] == [{"f": [{"v": "7"}]}]
    assert run(api, "SELECT COUNT(*) FROM t", defaultDataset={"projectId": "project1", "datasetId": "d"})[1]["rows"] == [{"f": [{"v": "3"}]}]


def test_job_kinds(api, tmp_path):
    run(api, "CREATE SCHEMA d; CREATE TABLE d.t AS SELECT 1 AS a UNION ALL SELECT 2")
    ref = lambda t: {"projectId": "project1", "datasetId": "d", "tableId": t}

    def job(conf):
        job_id = f"j{time.time_ns()}"
        call(api, "POST", "/projects/project1/jobs", {"configuration": conf, "jobReference": {"jobId": job_id}})
        j = api.jobs.get("project1", job_id)
        assert api.jobs.wait(j, 60)
        return j

    assert job({"query": {"query": "SELECT a + 10 AS a FROM d.t", "destinationTable": ref("dest"), "writeDisposition": "WRITE_TRUNCATE"}}).error is None
    assert job({"query": {"query": "SELECT 1 AS a", "destinationTable": ref("dest")}}).error["status"] == 409
    assert job({"copy": {"sourceTable": ref("dest"), "destinationTable": ref("copy")}}).error is None
    assert job({"extract": {"sourceTable": ref("copy"), "destinationUris": [f"file://{tmp_path}/out/*.csv"]}}).error is None
    assert job({"load": {"sourceUris": [f"file://{tmp_path}/out"], "destinationTable": ref("t"), "skipLeadingRows": 1}}).error is None
    rows = run(api, "SELECT a FROM d.t ORDER BY a")[1]["rows"]
    assert [r["f"][0]["v"] for r in rows] == ["1", "2", "11", "12"]
    assert len(call(api, "GET", "/projects/project1/jobs")[1]["jobs"]) >= 6


def test_cancel(api):
    api.engine.register("numbers", api.engine.spark.range(0, 10**13, 1, 64))
    j = api.jobs.submit("project1", {"query": {"query": "SELECT SUM(MOD(id, 7)) AS s FROM numbers"}})
    while j.state == "PENDING":
        time.sleep(0.05)
    for _ in range(100):
        call(api, "POST", f"/projects/project1/jobs/{j.job_id}/cancel")
        if api.jobs.wait(j, 0.5):
            break
    assert j.state == "DONE" and j.error["reason"] == "stopped"
    assert call(api, "DELETE", f"/projects/project1/jobs/{j.job_id}/delete")[0] == 204 and call(api, "GET", f"/projects/project1/jobs/{j.job_id}")[0] == 404


def test_errors_and_unimplemented(api):
    assert call(api, "GET", "/nowhere")[0] == 404 and call(api, "PUT", "/projects/p/jobs")[0] == 405
    assert call(api, "POST", "/projects/p/datasets", {})[0] == 422
    assert call(api, "GET", "/projects/p/datasets/d/models")[0] == 501 and call(api, "POST", "/projects/p/datasets/d:undelete")[0] == 501
    assert "@" in call(api, "GET", "/projects/p/serviceAccount")[1]["email"]


def test_over_http(engine):
    server = serve(engine, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/any/v2/projects/project1/queries"
        req = urllib.request.Request(url, json.dumps({"query": "SELECT 'é' AS a"}).encode(), {"Content-Type": "application/json"})
        assert json.load(urllib.request.urlopen(req))["rows"] == [{"f": [{"v": "é"}]}]
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(urllib.request.Request(url, b"{", {"Content-Type": "application/json"}))
        assert e.value.code == 400
    finally:
        server.shutdown()


def test_repl(engine):
    out = io.StringIO()
    r = Repl(engine, out)
    for line in ("CREATE SCHEMA d;", "CREATE TABLE d.tab AS", "SELECT 5 AS five;", "SELECT * FROM", "d.tab;", "SELECT nope;", "help"):
        assert r.feed(line)
    text = out.getvalue()
    assert "CREATE_TABLE done" in text and "five" in text and "Error:" in text and "semicolon" in text
    assert r.complete("d.ta", 0) == "d.tab" and not r.feed("exit")
    r.feed("reset")
    assert engine.catalog.projects() == []


def test_discovery(api):
    doc = call(api, "GET", "/$discovery/rest")[1]
    assert doc == call(api, "GET", "/discovery/v1/apis/any/v2/rest")[1]
    assert doc["methods"]["tables_get"] == {"httpMethod": "GET", "path": "projects/{project}/datasets/{dataset}/tables/{table}"}
