"""``python -m capturelake probe FILE...`` and ``python -m capturelake cut IN OUT START_SEC LEN_SEC``."""

from __future__ import annotations

import sys

from capturelake import api
from capturelake.session import session


def main(args: list[str]) -> int:
    if len(args) >= 2 and args[0] == "probe":
        rows = api.report(api.probe(session(), args[1:])).collect()
        for r in rows:
            print("\n".join(f"{k:<22}: {v}" for k, v in r.asDict().items()))
        return 0 if all(r.ok for r in rows) else 1
    if len(args) == 5 and args[0] == "cut":
        spark = session()
        request = spark.createDataFrame([(args[1], float(args[3]), float(args[4]))], "path string, start_sec double, len_sec double")
        made = api.plan_cuts(request, api.probe(spark, [args[1]])).first()
        if made.error:
            print(made.error, file=sys.stderr)
            return 1
        ok, code, said = api.sink.run_tool(args[1], args[2], made.start_samples, made.length_samples)
        print(said, end="", file=sys.stderr)
        return 0 if ok else 1
    print(__doc__, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
