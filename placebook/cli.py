"""Command line: serve, forward and reverse."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from placebook.geocoder import Geocoder


def line(result: dict, tag: bool = True) -> str:
    fuzzy = ", fuzzy" if tag and result["match_type"] == "fuzzy" else ""
    return f"{result['lat']:.6f}, {result['lon']:.6f} — {result['address']['full']} (confidence: {result['confidence']:.2f}{fuzzy})"


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("placebook")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("serve", "forward", "reverse"):
        sub = commands.add_parser(name)
        sub.add_argument("-d", "--data", required=True)
        sub.add_argument("-f", "--format")
        if name == "serve":
            sub.add_argument("-b", "--bind", default="127.0.0.1:3000")
        elif name == "forward":
            sub.add_argument("query")
        else:
            sub.add_argument("--lon", type=float, required=True)
            sub.add_argument("--lat", type=float, required=True)
    given = parser.parse_args(args)
    geocoder = Geocoder.from_file(SparkSession.builder.appName("placebook").getOrCreate(), given.data, given.format)
    if given.command == "serve":
        from placebook.service import serve

        serve(geocoder, given.bind)
        return 0
    results = geocoder.forward(given.query) if given.command == "forward" else geocoder.reverse(given.lon, given.lat, 5)
    for r in results:
        print(line(r, given.command == "forward"))
    if not results:
        print("No results found.")
    return 0


if __name__ == "__main__":
    sys.exit(main())
