"""Command line: drawings and hotspots of metafiles into a folder."""

from __future__ import annotations

import argparse
import logging
import sys

from glyphlake import api


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="glyphlake", description="Write the drawing and the hotspots of each metafile.")
    parser.add_argument("source", help="a metafile or a folder of them")
    parser.add_argument("output", help="folder of the results, seen by all executors")
    parser.add_argument("--pattern", default="*", help="names of the files to read in a folder")
    parser.add_argument("--debug", action="store_true", help="log more and write a report of the rasters")
    args = parser.parse_args(argv)
    if args.debug:
        logging.basicConfig(level=logging.DEBUG, format="%(levelname)s:%(name)s:%(message)s")
    spark = api.session()
    files = api.read_metafiles(spark, args.source, args.pattern)
    parsed = api.elements(files).persist()
    try:
        paths = [r.path for part in (api.write_rendered(files, args.output, parsed, args.debug), api.write_hotspots(files, args.output, parsed)) for r in part.toLocalIterator()]
    except Exception as x:  # noqa: BLE001  the message of a failed query is all that helps here
        print(f"Error: {str(x).splitlines()[0]}", file=sys.stderr)
        return 1
    print(*sorted(paths), sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
