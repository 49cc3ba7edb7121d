"""Commands: ``list`` and ``run`` queries, ``index`` a table of bands, list and verify the ``zoo``, list and run a ``pipeline``, ``infer`` with a model file, and ``info``."""

from __future__ import annotations

import argparse
import json
import sys


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("geospan").getOrCreate()


def _list(given) -> int:
    from geospan.plans.catalog import QUERIES

    print("\n".join(sorted(QUERIES)))
    return 0


def _run(given) -> int:
    from geospan.plans.catalog import QUERIES

    if given.name not in QUERIES:
        print(f"no query {given.name}", file=sys.stderr)
        return 1
    QUERIES[given.name](_session(), given.folder).show(given.rows, truncate=60)
    return 0


def _index(given) -> int:
    from geospan.functions.indices import compute_index

    compute_index(given.name, _session().read.parquet(given.table)).write.mode("overwrite").parquet(given.out)
    return 0


def _info(given) -> int:
    from geospan import zoo
    from geospan.plans.catalog import QUERIES
    from geospan.workflow import PipelineRegistry

    print(json.dumps({"queries": len(QUERIES), "models": len(zoo.MODELS.rows), "pipelines": PipelineRegistry.ids()}))
    return 0


def _zoo(given) -> int:
    from geospan import zoo
    from geospan.sources import features

    if given.what == "where":
        print(zoo.model_path(given.model or "", given.cache))
    elif given.what == "list":
        for key in zoo.list_models(given.task, given.domain):
            print(json.dumps(zoo.MODELS.get(key)) if given.json else key)
    else:
        with open(given.manifest, encoding="utf-8") as lines:
            told = list(features.manifest(lines.read().splitlines()))
        bad = [r.name for r in features.verify_files(_session(), zoo.model_path(given.model, given.cache), told).collect() if not r.ok]
        print("\n".join(f"differs or is missing: {name}" for name in bad) or "all files are as they should be")
        return 1 if bad else 0
    return 0


def _pipeline(given) -> int:
    from geospan import zoo  # noqa: F401
    from geospan.workflow import PipelineRegistry

    if given.what == "list":
        print("\n".join(PipelineRegistry.ids()))
        return 0
    spark = _session()
    tables = dict(pair.split("=", 1) for pair in given.inputs)
    journal = PipelineRegistry.create(given.name).run({name: spark.read.parquet(path) for name, path in tables.items()})
    print(json.dumps({"run_id": journal.run_id, "status": journal.status, "outputs": journal.outputs}))
    return 0


def _infer(given) -> int:
    from geospan.operators.inference import onnx_scores

    with open(given.model, "rb") as data:
        scores = onnx_scores(_session().read.parquet(given.table), data.read(), given.vector, given.key)
    scores.write.mode("overwrite").parquet(given.out)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="geospan", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, run, *arguments: tuple) -> None:
        own = commands.add_parser(name)
        own.set_defaults(run=run)
        for names, options in arguments:
            own.add_argument(*names.split(), **options)

    command("list", _list)
    command("info", _info)
    command("run", _run, ("name", {}), ("folder", {}), ("--rows", {"type": int, "default": 20}))
    command("index", _index, ("name", {}), ("table", {}), ("out", {}))
    command("zoo", _zoo, ("what", {"choices": ["list", "verify", "where"]}), ("model", {"nargs": "?"}), ("--task", {}), ("--domain", {}), ("--json", {"action": "store_true"}), ("--cache", {}), ("--manifest", {}))
    command("pipeline", _pipeline, ("what", {"choices": ["list", "run"]}), ("name", {"nargs": "?"}), ("inputs", {"nargs": "*", "default": []}))
    command("infer", _infer, ("model", {}), ("table", {}), ("out", {}), ("--vector", {"default": "data"}), ("--key", {"default": "id"}))
    given = parser.parse_args(argv)
    return given.run(given)


if __name__ == "__main__":
    sys.exit(main())
