"""``python -m quire check ROOT [--format plain|github]``: report every document below ROOT that the profile refuses."""

from __future__ import annotations

import argparse
import sys

from quire.operators import checker
from quire.session import session
from quire.sources import files


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quire")
    run = parser.add_subparsers(dest="command", required=True).add_parser("check")
    run.add_argument("root")
    run.add_argument("named", nargs="*", help="files below the root to read whatever their suffix")
    run.add_argument("--format", choices=["plain", "github"], default="plain")
    args = parser.parse_args(argv)
    found = checker.verdicts(files.decoded(files.collect(session("check"), args.root, args.named))).cache()
    for row in checker.report(found, args.format == "github").orderBy("path").toLocalIterator():
        print(row.line)
    total = checker.summary(found).first()
    print(f"{total.checked} file(s) checked, {total.refused} refused")
    return total.exit_code


if __name__ == "__main__":
    sys.exit(main())
