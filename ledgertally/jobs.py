"""One job per question: read the dumps, answer, write the result into a folder of its own.

    spark-submit run_job.py monthly-transactions --transactions s3a://…/transactions.csv --out s3a://…/results

Paths are anything Spark can read; credentials and endpoints are Spark's own settings (``spark.hadoop.fs.s3a.*``).
``--staged`` says that text dumps were turned to parquet by the ``stage`` job before.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from inspect import signature

from pyspark.sql import DataFrame, SparkSession

from ledgertally.plans import questions, studies
from ledgertally.sinks.results import (
    preview,
    report_csv,
    run_folder,
    write_csv,
    write_json,
    write_json_array,
    write_rendered_array,
)
from ledgertally.sources.layouts import BLOCKS, BLOCKS_SCHEMA, CONTRACTS, SCAMS, TRANSACTIONS, Layout
from ledgertally.sources.lines import read_fields, read_staged, stage_fields
from ledgertally.sources.results import read_pairs, read_rendered, read_result_csv
from ledgertally.sources.registry_scan import read_registry_entries
from ledgertally.sources.tables import read_csv

LAYOUTS: dict[str, Layout] = {
    "transactions": TRANSACTIONS,
    "contracts": CONTRACTS,
    "blocks": BLOCKS,
    "scams": SCAMS,
}


@dataclass(frozen=True)
class Job:
    question: Callable[..., DataFrame]
    inputs: tuple[str, ...]
    form: str
    titles: tuple[str, ...]


# The titles of the published reports.
JOBS: dict[str, Job] = {
    "monthly-transactions": Job(questions.monthly_transactions, ("transactions",), "pairs", ("Date", "Value")),
    "monthly-value": Job(questions.monthly_value, ("transactions",), "rendered", ("Date", "Value")),
    "top-contracts": Job(
        questions.top_contracts, ("transactions", "contracts"), "pairs", ("Address", "Ether Value")
    ),
    "top-miners": Job(questions.top_miners, ("blocks",), "pairs", ("Miner", "Size")),
    "monthly-gas-price": Job(questions.monthly_gas_price, ("transactions",), "text-pairs", ("Date", "Value")),
    "monthly-contract-gas": Job(
        questions.monthly_contract_gas, ("transactions", "contracts"), "text-pairs", ("Date", "Value")
    ),
    "top-scams": Job(questions.top_scams, ("transactions", "scams"), "pairs", ("ID", "Type", "Score")),
    "monthly-scam-value": Job(
        questions.monthly_scam_value, ("transactions", "registry"), "pairs", ("Date", "Type", "Amount")
    ),
    "top-self-transfers": Job(
        questions.top_self_transfers, ("transactions",), "pairs", ("From", "To", "Value")
    ),
    "monthly-activity": Job(studies.monthly_activity, ("transactions",), "csv", ("Date", "Transactions", "Value")),
    "monthly-gas": Job(studies.monthly_gas, ("transactions", "contracts"), "text-pairs", ("Question", "Date", "Value")),
    "popular-contract-gas": Job(
        studies.popular_contract_gas,
        ("transactions", "contracts"),
        "csv",
        ("Date", "Gas", "Calls", "Popular Gas", "Popular Calls"),
    ),
    "trade-rings": Job(studies.trade_rings, ("transactions",), "csv", ("Ring", "Traders", "Pairs", "Transfers", "Value")),
    "contract-types": Job(studies.contract_types, ("transactions", "contracts"), "csv", ("Type", "Contracts", "Calls")),
    "droppable-block-bytes": Job(
        questions.droppable_block_bytes, ("block_table",), "csv", ("column_name", "size_bytes")
    ),
    "block-column-shares": Job(
        questions.block_column_shares, ("block_table",), "csv", ("column_name", "space_saved", "percentage_saved")
    ),
}


def read_input(spark: SparkSession, name: str, path: str, staged: bool = False, infer: bool = False) -> DataFrame:
    if name == "registry":
        return read_registry_entries(spark, path)
    if name == "block_table":
        return read_csv(spark, path, None if infer else BLOCKS_SCHEMA)
    layout = LAYOUTS[name]
    return read_staged(spark, path, layout) if staged else read_fields(spark, path, layout)


def write_result(result: DataFrame, form: str, path: str) -> None:
    """The published form of a result, in one file: an array of pairs, of pairs with text values, of joined texts, or a CSV."""
    if form == "csv":
        write_csv(result, path, single=True)
    elif form == "rendered":
        write_rendered_array(result, path, single=True)
    elif form == "lines":
        write_json(result, path)
    else:
        write_json_array(result, path, value_as_text=form == "text-pairs", single=True)


def run_job(
    spark: SparkSession,
    name: str,
    paths: dict[str, str],
    out: str,
    form: str | None = None,
    staged: bool = False,
    infer: bool = False,
    limit: int | None = None,
) -> str:
    """Answer one question and give the folder the result is in. ``limit`` keeps the first months of a month question."""
    job = JOBS[name]
    frames = [read_input(spark, key, paths[key], staged, infer) for key in job.inputs]
    folder = run_folder(out, name)
    result = job.question(*frames) if limit is None else job.question(*frames, limit=limit)
    write_result(result, form or job.form, folder)
    return folder


def read_job_result(spark: SparkSession, name: str, folder: str, form: str | None = None) -> DataFrame:
    """The rows of a job's result, as texts under the job's titles."""
    job = JOBS[name]
    form = form or job.form
    if form == "csv":
        return read_result_csv(spark, folder, job.titles)
    if form == "lines":
        return spark.read.json(folder)
    return (read_rendered if form == "rendered" else read_pairs)(spark, folder, job.titles)


def convert_result(spark: SparkSession, name: str, source: str, target: str) -> None:
    """The JSON result of a job as one CSV with that job's titles."""
    job = JOBS[name]
    report_csv(spark, source, target, job.titles, "rendered" if job.form == "rendered" else "pairs")


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ledgertally", description=__doc__.splitlines()[0])
    parser.add_argument("job", choices=[*JOBS, "stage", "convert"])
    for name in [*LAYOUTS, "registry", "block_table"]:
        parser.add_argument(f"--{name.replace('_', '-')}", help=f"path of the {name.replace('_', ' ')}")
    parser.add_argument("--out", required=True, help="base folder of the results, or the target of stage and convert")
    parser.add_argument("--form", choices=["pairs", "text-pairs", "rendered", "csv", "lines"])
    parser.add_argument("--staged", action="store_true", help="the dumps are parquet written by the stage job")
    parser.add_argument("--infer", action="store_true", help="infer the types of the block table")
    parser.add_argument("--result", help="convert: the JSON result to read")
    parser.add_argument("--of", choices=list(JOBS), help="convert: the job it came from")
    parser.add_argument("--limit", type=int, help="month questions: keep only the first months")
    parser.add_argument("--preview", type=int, default=0, help="show that many rows of the result")
    options = parser.parse_args(arguments)
    paths = {name: getattr(options, name) for name in [*LAYOUTS, "registry", "block_table"] if getattr(options, name)}
    spark = SparkSession.builder.appName(f"ledgertally {options.job}").getOrCreate()

    if options.job == "stage":
        other = [name for name in paths if name not in LAYOUTS]
        if other or not paths:
            parser.error("stage needs text dumps: " + ", ".join(f"--{name}" for name in LAYOUTS) + ("; not " + ", ".join(other) if other else ""))
        for name, path in paths.items():
            stage_fields(read_fields(spark, path, LAYOUTS[name]), f"{options.out.rstrip('/')}/{name}")
        return
    if options.job == "convert":
        if not options.result or not options.of:
            parser.error("convert needs --result and --of")
        convert_result(spark, options.of, options.result, options.out)
        return
    missing = [name for name in JOBS[options.job].inputs if name not in paths]
    if missing:
        parser.error(f"{options.job} needs " + ", ".join("--" + name.replace("_", "-") for name in missing))
    months = "limit" in signature(JOBS[options.job].question).parameters
    if options.limit is not None and not months:
        parser.error(f"{options.job} has no months to limit")
    folder = run_job(spark, options.job, paths, options.out, options.form, options.staged, options.infer, options.limit)
    print(folder)
    if options.preview:
        preview(read_job_result(spark, options.job, folder, options.form), options.preview)


if __name__ == "__main__":
    main()
