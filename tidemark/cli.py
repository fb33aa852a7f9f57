"""Command line: list collections, inspect one."""

from __future__ import annotations

import argparse
import json

from tidemark.collection import Client
from tidemark.operators.versions import stats
from tidemark.session import session


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    parser.add_argument("root")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    inspect = commands.add_parser("inspect")
    inspect.add_argument("name")
    inspect.add_argument("--json", action="store_true")
    given = parser.parse_args(args)
    client = Client(session(), given.root)
    if given.command == "list":
        print("\n".join(client.list()))
        return 0
    own = client.get(given.name)
    found = stats(own.log.versions(), own.snapshot()).first().asDict() | {"dimensions": own.log.dimensions, "metric": own.log.metric}
    print(json.dumps(found) if given.json else "\n".join(f"{k}: {v}" for k, v in found.items()))
    return 0
