"""The REST surface on the standard library's HTTP server.

Routes are matched from ``projects/`` on, so any prefix before it is accepted.
"""

from __future__ import annotations

import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from .engine import Engine
from .errors import EngineError, Invalid, NotFound, Unsupported, translate
from .functions.types import rest_rows
from .jobs import Job, Jobs, scope_of

ROUTES: list[tuple[str, re.Pattern, str]] = []
_P, _D, _T, _J = "projects/(?P<project>[^/]+)", "/datasets/(?P<dataset>[^/:]+)", "/tables/(?P<table>[^/:]+)", "/(?P<job>[^/]+)"


def route(method: str, path: str):
    def add(f):
        ROUTES.append((method, re.compile(f"(?:.*/)?{path}/?$"), f.__name__))
        return f

    return add


def _dataset(project: str, dataset: str, info: dict) -> dict:
    return {"kind": "dataset", "location": "US", **info, "id": f"{project}:{dataset}", "datasetReference": {"projectId": project, "datasetId": dataset}}


class Api:
    def __init__(self, engine: Engine):
        self.engine, self.jobs = engine, Jobs(engine)
        self.catalog = engine.catalog

    def handle(self, method: str, path: str, query: dict[str, str], body: dict) -> tuple[int, dict | None]:
        """(status, response)."""
        try:
            known = False
            for m, pattern, name in ROUTES:
                if hit := pattern.match(path.lstrip("/")):
                    known = True
                    if m == method:
                        args = {k: unquote(v) for k, v in hit.groupdict().items()}
                        return getattr(self, name)(query=query, body=body, **args)
            if known:
                return _error(405, "invalid", f"{method} is not allowed here")
            raise NotFound(f"Not found: {path}")
        except Exception as e:
            new = translate(e)
            if isinstance(new, EngineError):
                return _error(new.status, new.reason, str(new))
            if isinstance(new, (KeyError, TypeError, ValueError)):
                return _error(422, "invalid", f"{type(new).__name__}: {new}")
            return _error(500, "internalError", str(new))

    # ---------------------------------------------------------------- projects
    @route("GET", "projects")
    def projects(self, query, body):
        names = self.catalog.projects()
        return 200, {"kind": "projectList", "projects": [{"id": p, "projectReference": {"projectId": p}, "friendlyName": p} for p in names], "totalItems": len(names)}

    @route("GET", f"{_P}/serviceAccount")
    def service_account(self, query, body, project):
        return 200, {"kind": "getServiceAccountResponse", "email": "service-account@example.com"}

    # ---------------------------------------------------------------- datasets
    @route("GET", f"{_P}/datasets")
    def datasets_list(self, query, body, project):
        return 200, {"kind": "datasetList", "datasets": [_dataset(project, d, self.catalog.get_dataset(project, d)) for d in self.catalog.datasets(project)]}

    @route("POST", f"{_P}/datasets")
    def datasets_insert(self, query, body, project):
        d = body["datasetReference"]["datasetId"]
        return 200, _dataset(project, d, self.catalog.create_dataset(body["datasetReference"].get("projectId") or project, d, body))

    @route("GET", f"{_P}{_D}")
    def datasets_get(self, query, body, project, dataset):
        return 200, _dataset(project, dataset, self.catalog.get_dataset(project, dataset))

    @route("PATCH", f"{_P}{_D}")
    def datasets_patch(self, query, body, project, dataset):
        return 200, _dataset(project, dataset, self.catalog.update_dataset(project, dataset, body, merge=True))

    @route("PUT", f"{_P}{_D}")
    def datasets_update(self, query, body, project, dataset):
        return 200, _dataset(project, dataset, self.catalog.update_dataset(project, dataset, body, merge=False))

    @route("DELETE", f"{_P}{_D}")
    def datasets_delete(self, query, body, project, dataset):
        self.catalog.delete_dataset(project, dataset)
        return 204, None

    @route("POST", f"{_P}{_D}:undelete")
    def datasets_undelete(self, query, body, project, dataset):
        raise Unsupported("A deleted dataset cannot be restored")

    # ------------------------------------------------------------------ tables
    def _table(self, project: str, dataset: str, table: str) -> dict:
        name = (project, dataset, table)
        return {"kind": "table", **self.catalog.rest_table(name), "id": f"{project}:{dataset}.{table}", "tableReference": {"projectId": project, "datasetId": dataset, "tableId": table}}

    @route("GET", f"{_P}{_D}/tables")
    def tables_list(self, query, body, project, dataset):
        names = self.catalog.tables(project, dataset)
        items = [{"kind": "table", "id": f"{project}:{dataset}.{t}", "type": "TABLE", "tableReference": {"projectId": project, "datasetId": dataset, "tableId": t}} for t in names]
        return 200, {"kind": "tableList", "tables": items, "totalItems": len(items)}

    @route("POST", f"{_P}{_D}/tables")
    def tables_insert(self, query, body, project, dataset):
        t = body["tableReference"]["tableId"]
        if body.get("view"):
            text = self.engine.to_spark_sql(body["view"]["query"], scope=scope_of(project, {"datasetId": dataset}))
            self.catalog.create_view((project, dataset, t), text, body)
        else:
            self.catalog.create_from_rest(project, dataset, t, body)
        return 200, self._table(project, dataset, t)

    @route("GET", f"{_P}{_D}{_T}")
    def tables_get(self, query, body, project, dataset, table):
        return 200, self._table(project, dataset, table)

    @route("PATCH", f"{_P}{_D}{_T}")
    def tables_patch(self, query, body, project, dataset, table):
        self.catalog.patch_table((project, dataset, table), body, merge=True)
        return 200, self._table(project, dataset, table)

    @route("PUT", f"{_P}{_D}{_T}")
    def tables_update(self, query, body, project, dataset, table):
        self.catalog.patch_table((project, dataset, table), body, merge=False)
        return 200, self._table(project, dataset, table)

    @route("DELETE", f"{_P}{_D}{_T}")
    def tables_delete(self, query, body, project, dataset, table):
        self.catalog.drop((project, dataset, table))
        return 204, None

    @route("GET", f"{_P}{_D}{_T}/data")
    def tabledata_list(self, query, body, project, dataset, table):
        df = self.catalog.table((project, dataset, table))
        start, size = _start(query), int(query.get("maxResults") or 10_000)
        total = df.count()
        rows = rest_rows(df.offset(start).limit(size).collect(), df.schema)
        out = {"kind": "tableDataList", "rows": rows, "totalRows": str(total)}
        return 200, out | ({"pageToken": str(start + len(rows))} if rows and start + len(rows) < total else {})

    @route("POST", f"{_P}{_D}{_T}/insertAll")
    def tabledata_insert(self, query, body, project, dataset, table):
        errors = self.engine.insert_all((project, dataset, table), body.get("rows") or [], bool(body.get("skipInvalidRows")), bool(body.get("ignoreUnknownValues")))
        return 200, {"kind": "tableDataInsertAllResponse"} | ({"insertErrors": errors} if errors else {})

    # -------------------------------------------------------------------- jobs
    @route("GET", f"{_P}/jobs")
    def jobs_list(self, query, body, project):
        return 200, {"kind": "jobList", "jobs": [{**j.resource(), "state": j.state} for j in self.jobs.list(project)]}

    @route("POST", f"{_P}/jobs")
    def jobs_insert(self, query, body, project):
        job = self.jobs.submit(project, body["configuration"], (body.get("jobReference") or {}).get("jobId"))
        self.jobs.wait(job, 0.2)
        if job.state == "DONE" and job.error and job.error["status"] in (400, 404, 409):
            return _error(job.error["status"], job.error["reason"], job.error["message"])
        return 200, job.resource()

    @route("GET", f"{_P}/jobs{_J}")
    def jobs_get(self, query, body, project, job):
        return 200, self.jobs.get(project, job).resource()

    @route("POST", f"{_P}/jobs{_J}/cancel")
    def jobs_cancel(self, query, body, project, job):
        return 200, {"kind": "jobCancelResponse", "job": self.jobs.cancel(project, job).resource()}

    @route("DELETE", f"{_P}/jobs{_J}/delete")
    def jobs_delete(self, query, body, project, job):
        self.jobs.delete(project, job)
        return 204, None

    @route("POST", f"{_P}/queries")
    def jobs_query(self, query, body, project):
        conf = {k: body[k] for k in ("query", "defaultDataset", "queryParameters", "dryRun", "parameterMode") if k in body}
        job = self.jobs.submit(project, {"query": conf})
        self.jobs.wait(job, float(body.get("timeoutMs") or 600_000) / 1000)
        return self._results(job, query | {k: str(body[k]) for k in ("maxResults",) if body.get(k) is not None})

    @route("GET", f"{_P}/queries{_J}")
    def jobs_results(self, query, body, project, job):
        j = self.jobs.get(project, job)
        self.jobs.wait(j, float(query.get("timeoutMs") or 10_000) / 1000)
        return self._results(j, query)

    def _results(self, job: Job, query: dict) -> tuple[int, dict | None]:
        ref = {"projectId": job.project, "jobId": job.job_id, "location": "US"}
        if job.state != "DONE":
            return 200, {"kind": "queryResponse", "jobReference": ref, "jobComplete": False}
        if job.error:
            return _error(job.error["status"], job.error["reason"], job.error["message"])
        size = int(query["maxResults"]) if query.get("maxResults") else None
        rows, nxt = self.jobs.page(job, _start(query), size)
        out = {"kind": "queryResponse", "jobReference": ref, "jobComplete": True, "schema": job.schema or {"fields": []}, "rows": rows, "totalRows": str(job.total), "totalBytesProcessed": "0", "cacheHit": False}
        if job.result and job.result.affected is not None:
            out["numDmlAffectedRows"] = str(job.result.affected)
        return 200, out | ({"pageToken": str(nxt)} if nxt is not None else {})

    # --------------------------------------------------------------- discovery
    @route("GET", r"\$discovery/rest")
    @route("GET", r"discovery/v1/apis/[^/]+/[^/]+/rest")
    def discovery(self, query, body):
        """The routes, by handler, in the form of a discovery document."""
        methods = {name: {"httpMethod": m, "path": re.sub(r"\(\?P<(\w+)>[^)]*\)", r"{\1}", pattern.pattern[len("(?:.*/)?") : -len("/?$")])} for m, pattern, name in ROUTES if name not in ("nothing", "discovery")}
        return 200, {"kind": "discovery#restDescription", "protocol": "rest", "methods": methods}

    # -------------------------------------------------- declared, without behaviour
    def nothing(self, query, body, **_):
        raise Unsupported("Not implemented")


for _method in ("GET", "POST", "PUT", "PATCH", "DELETE"):
    for _path in (f"{_P}{_D}/(?:models|routines)(?:/.*)?", f"{_P}{_D}{_T}/rowAccessPolicies.*", f"{_P}{_D}{_T}:.*"):
        ROUTES.append((_method, re.compile(f"(?:.*/)?{_path}$"), "nothing"))


def _start(query: dict) -> int:
    text = query.get("pageToken") or query.get("startIndex") or "0"
    if not text.isdigit():
        raise Invalid(f"Invalid page token {text}")
    return int(text)


def _error(status: int, reason: str, message: str) -> tuple[int, dict]:
    return status, {"error": {"code": status, "message": message, "status": reason, "errors": [{"reason": reason, "message": message, "domain": "global"}]}}


def serve(engine: Engine, port: int = 9050, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server, not started yet; call ``serve_forever``."""
    api = Api(engine)

    class Request(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _go(self) -> None:
            url = urlsplit(self.path)
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if self.headers.get("Content-Encoding") == "gzip":
                import gzip

                raw = gzip.decompress(raw)
            try:
                body = json.loads(raw) if raw else {}
            except ValueError:
                status, out = _error(400, "parseError", "The body is not JSON")
            else:
                status, out = api.handle(self.command, url.path, {k: v[-1] for k, v in parse_qs(url.query).items()}, body)
            data = b"" if out is None else json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_PATCH = do_DELETE = _go

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Request)


def main() -> None:
    import argparse

    from .session import create_session

    p = argparse.ArgumentParser(description="Serves the engine over HTTP.")
    p.add_argument("--port", type=int, default=9050)
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--data-dir")
    p.add_argument("--master")
    a = p.parse_args()
    server = serve(Engine(create_session(master=a.master), a.data_dir), a.port, a.host)
    print(f"listening on {a.host}:{a.port}", flush=True)
    server.serve_forever()


if __name__ == "__main__":
    main()
