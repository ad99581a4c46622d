"""python -m gatewell generate --campaign FILE --donors FILE --output FILE; export-schemas --output-dir FOLDER; review"""

from __future__ import annotations

import argparse
import json
import sys

from gatewell.plans import contracts
from gatewell.sources import campaign, jsonl


def _generate(args: argparse.Namespace) -> int:
    if any(jsonl.same_file(args.output, x) for x in (args.campaign, args.donors)):
        print("the output must be another file than the inputs", file=sys.stderr)
        return 2
    try:
        chosen = campaign.load(args.campaign)
    except (OSError, ValueError):  # a CampaignError is a ValueError
        print("the campaign can't be used; no record was judged", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from gatewell.plans import engine

    found = jsonl.write(engine.run(jsonl.scan(SparkSession.builder.getOrCreate(), args.donors), chosen), args.output)
    print(json.dumps(found))
    return jsonl.exit_code(found)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gatewell", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    generate = commands.add_parser("generate", help="judge records by a campaign")
    for name in ("campaign", "donors", "output"):
        generate.add_argument(f"--{name}", required=True)
    commands.add_parser("export-schemas", help="write the JSON Schemas").add_argument("--output-dir", required=True)
    args = parser.parse_args(argv)
    if args.command == "generate":
        return _generate(args)
    contracts.write(args.output_dir)
    return 0


if __name__ == "__main__":
    sys.exit(main())
