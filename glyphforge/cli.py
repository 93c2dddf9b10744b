"""Command line: glyphforge LANG [TEXT] [--to LANG] [--ipa] [--sep S] [--charts FOLDER] [--lines] [--list]"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .functions.tables import ENGLISH_CODES
from .operators.convert import Converter, convert_to_ipa
from .operators.segment import G2P, English
from .plans.charts import LanguageNotFoundError
from .sources.charts import Catalog, bundled


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="glyphforge", description="Segment or convert text, line by line.")
    p.add_argument("lang", nargs="?")
    p.add_argument("text", nargs="?", help="a text; else standard input")
    p.add_argument("--to", help="write in this language's spelling, in 'universal' or in 'proxy'")
    p.add_argument("--ipa", action="store_true", help="sounds by way of the shared spelling")
    p.add_argument("--sep", help="between units")
    p.add_argument("--charts", help="a folder of chart files")
    p.add_argument("--lines", action="store_true", help="convert standard input line by line, as it comes")
    p.add_argument("--list", action="store_true")
    args = p.parse_args(argv)
    catalog = bundled()
    if args.charts:
        catalog = Catalog({c["code"]: c for c in (json.loads(f.read_text(encoding="utf-8")) for f in sorted(Path(args.charts).glob("*.json")))})
    if args.list or not args.lang:
        for code, entry in catalog.registry().items():
            print(f"{code}\t{entry.get('name') or ''}")
        return 0
    try:
        if args.ipa:
            sep = " " if args.sep is None else args.sep
            convert = lambda x: convert_to_ipa(x, args.lang, sep=sep, catalog=catalog)
        elif args.to:
            to = Converter(args.lang, args.to, catalog=catalog)
            convert = lambda x: to.convert(x, args.sep or "")
        else:
            reader = English() if args.lang in ENGLISH_CODES else G2P(args.lang, catalog=catalog)
            convert = lambda x: reader.convert(x, " " if args.sep is None else args.sep)
        if args.text is not None:
            print(convert(args.text))
        elif args.lines:
            for line in sys.stdin:
                print(convert(line.rstrip("\n")), flush=True)
        else:
            print(convert(sys.stdin.read()))
    except LanguageNotFoundError as e:
        print(e.args[0], file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
