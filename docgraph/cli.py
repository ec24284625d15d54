"""Command line: parse, rebuild, workspace parse|validate|files, query, index and search.

``python -m docgraph.cli query <folder> "<sql or #id>" [-f table|json]``
"""

from __future__ import annotations

import argparse
import json
import sys


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("docgraph").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="docgraph")
    sub = p.add_subparsers(dest="what", required=True)
    one = sub.add_parser("parse", help="objects of a document (- for standard input)")
    one.add_argument("file")
    one.add_argument("--format", default="standard", choices=["minimal", "standard", "full"])
    back = sub.add_parser("rebuild", help="a document from its objects")
    back.add_argument("file")
    ws = sub.add_parser("workspace")
    ws.add_argument("how", choices=["parse", "validate", "files"])
    ws.add_argument("folder")
    q = sub.add_parser("query")
    q.add_argument("folder")
    q.add_argument("sql")
    q.add_argument("-f", "--format", default="table", choices=["table", "json"])
    q.add_argument("-w", "--workspace")
    s = sub.add_parser("search", help="by meaning, with the hashing embedder")
    s.add_argument("folder")
    s.add_argument("text")
    s.add_argument("-k", type=int, default=10)
    a = p.parse_args(argv)
    read = lambda name: sys.stdin.read() if name == "-" else open(name, encoding="utf-8").read()
    if a.what == "parse":
        from docgraph.sources.parse import parse

        print(json.dumps(parse(read(a.file), format=a.format), ensure_ascii=False, indent=2))
        return 0
    if a.what == "rebuild":
        from docgraph.sources.render import rebuild

        print(rebuild(json.loads(read(a.file))), end="")
        return 0
    from docgraph.api import Graph
    from docgraph.session import Refused
    from docgraph.sources.render import to_json, to_table

    g = Graph.open(_session(), a.folder)
    if a.what == "workspace":
        if a.how == "files":
            from docgraph.sources.load import file_order

            print("\n".join(r[0] for r in g.files.select("file").orderBy(file_order(g.files["file"])).toLocalIterator()))
            return 0
        got = g.to_json() if a.how == "parse" else g.validate(limit=1000)
        print(json.dumps(got, ensure_ascii=False, indent=2, default=str))
        return int(a.how == "validate" and any(d["severity"] == "error" for d in got["diagnostics"]))
    if a.what == "search":
        from docgraph.operators.embed import HashingEmbedder

        e = HashingEmbedder()
        print(to_table(g.semantic_search(a.text, g.index(e), e, a.k)))
        return 0
    try:
        df = g.engine.sql(a.sql, a.workspace)
        print(to_table(df) if a.format == "table" else json.dumps(to_json(df), ensure_ascii=False, default=str))
    except Refused as e:
        print(json.dumps(e.envelope()), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
