"""``python -m brindle ROOT``: a prompt on a database; ``--serve HOST:PORT`` answers JSON lines instead."""

import sys

from pyspark.sql import SparkSession

from brindle.connection import Server, prompt
from brindle.engine import Engine


def main(args: list[str]) -> None:
    if not args:
        sys.exit(__doc__)
    engine = Engine(SparkSession.builder.appName("brindle").getOrCreate(), args[0])
    if args[1:2] == ["--serve"]:
        host, _, port = args[2].rpartition(":")
        with Server(engine, (host, int(port))) as server:
            server.serve_forever()
    else:
        prompt(engine, iter(sys.stdin.readline, ""))


if __name__ == "__main__":
    main(sys.argv[1:])
