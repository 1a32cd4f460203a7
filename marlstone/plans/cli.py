"""Command line: ``python -m marlstone.plans.cli --library DIR [-p PROJECT] COMMAND ...``"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.scalars import positive_limit
from ..schema import EngineConfig
from ..sources import formats
from ..sources.foreign import open_library
from ..sources.embed import provider
from ..operators.tree import rendered
from . import views
from .repository import Repository


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="marlstone")
    top.add_argument("--library", required=True)
    top.add_argument("-p", "--project", default="default")
    top.add_argument("-b", "--branch", default="main")
    top.add_argument("--embed-provider", default="hash")
    top.add_argument("--embed-model", default="")
    top.add_argument("--embed-url", default="")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: tuple) -> None:
        p = commands.add_parser(name)
        for flags, options in arguments:
            p.add_argument(*flags, **options)

    pos = lambda n, **k: ((n,), k)
    opt = lambda *n, **k: (n, k)
    flag = lambda n: ((n,), {"action": "store_true"})
    at, message = opt("--at"), opt("-m", "--message", default="")
    add("init")
    add("note-set", pos("path"), opt("--title"), opt("--body", default=""), opt("--tags", default=""), opt("--time", type=int), message, flag("--stage"))
    add("note-get", pos("path"), at)
    add("note-rm", pos("path"), message, flag("--stage"))
    add("note-ls", opt("--dir", default=""), at)
    add("dir-add", pos("path"), message)
    add("dir-ls", pos("path", nargs="?", default=""))
    add("dir-rm", pos("path"), flag("--recursive"), flag("--stage"), message)
    add("dir-tree", at, flag("--all"))
    add("log", opt("-n", "--limit"))
    add("diff", pos("base"), pos("tip"))
    add("reset", pos("ref"))
    add("stage")
    add("commit", message, flag("--abort"))
    add("pull", pos("remote"), opt("--remote-project"), opt("--remote-branch"), flag("--force"), flag("--merge"), flag("--allow-unrelated"), opt("--base"))
    add("merge", flag("--continue"), flag("--abort"), message)
    add("search", pos("query"), at, opt("-n", "--limit"), flag("--snippet"), flag("--hybrid"))
    add("index-rebuild", flag("--embed"), message)
    add("link-resolve", pos("slug"), at)
    add("bulk-import", pos("file"), message)
    add("import-md", pos("folder"), message)
    add("export-md", pos("folder"), at, flag("--force"))
    add("gc", opt("--keep-last", type=int))
    add("fsck")
    add("doctor", opt("--check", action="append"), flag("--list-checks"), opt("--serve-url", default="http://127.0.0.1:8080"))
    add("project-ls")
    add("project-create", pos("name"), opt("--description", default=""))
    add("project-desc", pos("name"), pos("description"))
    add("branch-ls")
    add("branch-desc", pos("name"), pos("description"))
    add("backup", pos("file"))
    add("restore", pos("file"), flag("--force"), flag("--library"))
    add("wipe", flag("--yes"))
    add("serve", opt("--port", type=int, default=8080), opt("--token", default=""))
    add("version")
    return top


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def run(spark: SparkSession, argv: list[str]):
    """Runs a command and gives its result as plain values."""
    a = parser().parse_args(argv)
    repo = Repository(spark, EngineConfig(a.library, a.project, a.branch))
    store, named = repo.store, {"message": a.message} if getattr(a, "message", "") else {}
    embedder = lambda: provider(a.embed_provider, a.embed_model, a.embed_url)
    match a.command:
        case "init" | "version":
            return {"library": store.describe(), "schema_version": store.meta_get("schema_version")}
        case "note-set":
            tags = [t.strip() for t in a.tags.split(",") if t.strip()]
            title = a.title or a.path
            return repo.stage_note(a.path, title, a.body, tags) if a.stage else repo.set_note(a.path, title, a.body, tags, created_at=a.time, **named)
        case "note-get":
            row = repo.note(a.path, a.at).asDict()
            return {k: row[k] for k in ("path", "title", "tags", "body")}
        case "note-rm":
            return repo.stage_remove_note(a.path) if a.stage else repo.remove_note(a.path, **named)
        case "note-ls":
            return _rows(views.note_ls_rows(repo.list_notes(a.dir, a.at)))
        case "dir-add":
            return repo.mkdir(a.path, **named)
        case "dir-ls":
            return _rows(repo.dir_ls(a.path))
        case "dir-rm":
            return repo.stage_remove_dir(a.path) if a.stage else repo.remove_dir(a.path, a.recursive, **named)
        case "dir-tree":
            return {n: rendered(t) for n, t in repo.all_trees().items()} if a.all else rendered(repo.dir_tree(a.at))
        case "log":
            return _rows(views.log_rows(repo.log(), positive_limit(a.limit)))
        case "diff":
            return _rows(views.diff_rows(repo.diff(a.base or None, a.tip or None)))
        case "reset":
            return {"abandoned": repo.reset(a.ref)}
        case "stage":
            return _rows(repo.stage_status())
        case "commit":
            return repo.abort_stage() if a.abort else {"applied": repo.commit_stage(**named)}
        case "pull":
            source = Repository(spark, EngineConfig(a.remote, a.remote_project or a.project, a.remote_branch or a.branch))
            where = {"project": a.remote_project, "branch": a.remote_branch}
            return repo.merge_start(source, **where, base=a.base, allow_unrelated=a.allow_unrelated) if a.merge else repo.pull(source, **where, force=a.force)
        case "merge":
            if getattr(a, "continue"):
                return repo.merge_continue(**named)
            return {"discarded": repo.merge_abort()} if a.abort else views.merge_state_row(a.project, a.branch, repo.merge_state())
        case "search":
            limit = positive_limit(a.limit)
            if a.hybrid:
                return _rows(repo.search_hybrid(a.query, embedder(), a.at, limit))
            return _rows(views.search_rows(repo.search(a.query, a.at, limit, a.snippet)))
        case "index-rebuild":
            return repo.rebuild_embeddings(embedder(), **named) if a.embed else repo.rebuild_index(**named)
        case "link-resolve":
            return repo.resolve_link(a.slug, a.at)
        case "bulk-import":
            return repo.bulk_import(formats.read_jsonl(spark, a.file).withColumns({"links": F.lit(None).cast("array<struct<slug:string,rel:string>>"), "created_at": F.lit(None).cast("long")}), **named)
        case "import-md":
            return repo.import_markdown(formats.read_markdown(spark, a.folder), **named)
        case "export-md":
            return {"written": formats.write_markdown(repo.export_markdown(a.at), a.folder, a.force)}
        case "gc":
            kept = []
            return repo.gc(a.keep_last, backup=kept.extend) | {"branches": kept}
        case "fsck":
            return _rows(repo.fsck())
        case "doctor":
            return list(repo.CHECKS) if a.list_checks else repo.doctor(a.check, a.serve_url)
        case "project-ls":
            return _rows(views.project_rows(store.project_stats()))
        case "project-create":
            return {"created": store.project_create(a.name, a.description)}
        case "project-desc":
            return store.project_describe(a.name, a.description)
        case "branch-ls":
            return [{k: b[k] for k in ("name", "addr", "description")} for b in store.branch_list(a.project)]
        case "branch-desc":
            return store.branch_describe(a.project, a.name, a.description)
        case "backup":
            return repo.dump().write.mode("overwrite").text(a.file)
        case "restore":
            return repo.restore_foreign(open_library(spark, a.file), a.force) if a.library else repo.restore(spark.read.text(a.file), a.force)
        case "wipe":
            return store.wipe() if a.yes else {"error": "wipe needs --yes"}
        case "serve":
            from .http import serve

            return serve(repo, a.port, a.token, embedder())


def main() -> int:
    spark = SparkSession.builder.appName("marlstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        found = run(spark, sys.argv[1:])
        print(json.dumps(found, ensure_ascii=False, indent=1, default=str))
        if isinstance(found, list) and any(isinstance(r, dict) and r.get("status") == "fail" for r in found):
            return 1  # a failed check of the doctor
    except EngineError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
