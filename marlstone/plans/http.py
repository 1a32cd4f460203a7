"""A thin HTTP form of a repository: read routes, and note writes behind a bearer token."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from .. import errors as E
from ..functions.scalars import positive_limit
from ..sources.embed import Embedder
from . import views
from .repository import Repository

_STATUS = (
    ((E.AmbiguousRef, E.AmbiguousSlug, E.EntryTypeConflict, E.InvalidPath, E.InvalidObject, ValueError, KeyError), 400),
    ((E.NoVectors, E.ModelMismatch, E.EmbedFailed, E.NoIndex), 409),
    ((E.NotFound,), 404),
    ((E.HeadMoved, E.Merging), 503),
)


def status_of(error: Exception) -> int:
    return next((code for kinds, code in _STATUS if isinstance(error, kinds)), 500)


def answer(repo: Repository, method: str, url: str, body: bytes = b"", auth: str = "", token: str = "", embedder: Embedder | None = None) -> tuple[int, object]:
    """Status and value of a request; no socket is needed to call it."""
    parts = urlparse(url)
    query = {k: v[0] for k, v in parse_qs(parts.query).items()}
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    try:
        match method, parts.path:
            case "GET", "/healthz":
                return 200, {"status": "ok", "backend": repo.store.describe(), "schema_version": repo.store.meta_get("schema_version"), "project": repo.project}
            case "GET", "/api/v1/projects":
                return 200, rows(views.project_rows(repo.store.project_stats()))
            case "GET", "/api/v1/tree":
                return 200, repo.dir_tree(query.get("at"))
            case "GET", "/api/v1/note":
                row = repo.note(query["path"], query.get("at"))
                return 200, {"path": row["path"], "title": row["title"], "tags": row["tags"] or [], "body": row["body"]}
            case "GET", "/api/v1/search":
                limit = positive_limit(query.get("limit"))
                if query.get("mode") == "hybrid":
                    return 200, rows(repo.search_hybrid(query["q"], embedder, query.get("at"), limit))
                return 200, rows(views.search_rows(repo.search(query["q"], query.get("at"), limit, query.get("snippet") == "1")))
            case "GET", "/api/v1/log":
                return 200, rows(views.log_rows(repo.log(), positive_limit(query.get("limit"))))
            case "GET", "/api/v1/diff":
                return 200, rows(views.diff_rows(repo.diff(query.get("from") or None, query.get("to") or None)))
            case "GET", "/api/v1/merge-state":
                view = repo.on(project=query.get("project", repo.project), branch=query.get("branch", repo.branch))
                return 200, views.merge_state_row(view.project, view.branch, view.merge_state())
            case ("POST" | "DELETE"), "/api/v1/note":
                if not token:
                    return 403, {"error": "writes are off: no token is configured"}
                if auth != f"Bearer {token}":
                    return 401, {"error": "bad token"}
                if method == "DELETE":
                    return 200, {"snapshot": repo.remove_note(query["path"])}
                item = json.loads(body)
                return 200, {"snapshot": repo.set_note(item["path"], item.get("title") or item["path"], item.get("body", ""), item.get("tags"))}
        return 404, {"error": "no such route"}
    except Exception as e:  # every failure becomes a status
        return status_of(e), {"error": f"{type(e).__name__}: {e}"}


def serve(repo: Repository, port: int, token: str = "", embedder: Embedder | None = None) -> None:
    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            code, value = answer(repo, self.command, self.path, body, self.headers.get("Authorization", ""), token, embedder)
            data = json.dumps(value, ensure_ascii=False, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _reply

    ThreadingHTTPServer(("127.0.0.1", port), Handler).serve_forever()
