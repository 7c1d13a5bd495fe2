"""python -m scenelake.cli build key=value ... | ground TEXT key=value ... | ask TEXT key=value ..."""

from __future__ import annotations

import sys


def main(argv: list[str] | None = None) -> int:
    args = list(sys.argv[1:] if argv is None else argv)
    if not args or args[0] not in ("build", "ground", "ask"):
        print(__doc__)
        return 2
    from pyspark.sql import SparkSession

    from .config import Config
    from .plans.build import Build
    from .shipping import ship

    texts = [a for a in args[1:] if "=" not in a]
    spark = ship(SparkSession.builder.appName("scene-graph").getOrCreate())
    graph = Build(spark, Config.of(*(a for a in args[1:] if "=" in a))).graph()
    if args[0] == "build":
        print(f"{graph.floors.count()} floors, {graph.rooms.count()} rooms, {graph.objects.count()} objects, {graph.chunks.count()} chunks")
        return 0
    queries = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "query_id string, text string")
    (graph.ground(queries) if args[0] == "ground" else graph.answer_question(queries)).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
