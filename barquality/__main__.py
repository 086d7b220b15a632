"""``python -m barquality ingest PATH... --store FOLDER [--frequency minute|daily]``"""

from __future__ import annotations

import argparse
import sys

from .plans.store import BarStore
from .schema import FREQUENCIES
from .session import build_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="barquality")
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="normalise files and store their bars")
    ingest.add_argument("paths", nargs="+")
    ingest.add_argument("--store", required=True)
    ingest.add_argument("--frequency", choices=FREQUENCIES)
    args = parser.parse_args(argv)
    store = BarStore(build_session(), args.store)
    try:
        results = store.ingest_paths(args.paths, args.frequency)
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 1
    for r in results:
        print(f"{r.source}: {r.rows_read} read, {r.rows_new} new, {r.rows_rejected} rejected, {r.rows_deduplicated} deduplicated, {r.rows_superseded} superseded")
    print(f"total: {len(results)} file(s), {sum(r.rows_read for r in results)} read, {sum(r.rows_new for r in results)} new, {sum(r.rows_rejected for r in results)} rejected")
    return 0


if __name__ == "__main__":
    sys.exit(main())
