"""Command line of the batch jobs, for ``spark-submit`` or ``python -m tideglass``."""

from __future__ import annotations

import argparse

from pyspark.ml.classification import LogisticRegressionModel

from tideglass.operators.models import evaluate
from tideglass.operators.scaling import RobustScaler
from tideglass.plans import jobs
from tideglass.session import build_session
from tideglass.sources.flow_logs import read_flow_log
from tideglass.sources.ground_truth import (
    read_labelled_flows,
    read_numeric_flows,
    read_positional_flows,
)
from tideglass.sources.tables import append_windows, save_model, save_report


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tideglass", description=__doc__)
    sub = parser.add_subparsers(dest="job", required=True)

    def job(name: str, text: str, *paths: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        for path in paths:
            p.add_argument(f"--{path}", required=True)
        return p

    p = job("windows", "flow logs to per-source windows", "input", "output")
    p.add_argument("--window", type=int, default=10)
    p.add_argument("--by-file", action="store_true")
    p.add_argument("--no-gap-fill", action="store_true")
    p = job("label", "label windows", "input", "output")
    p.add_argument("--mode", choices=["cic", "ctu13", "cic2018"], required=True)
    p.add_argument("--labels")
    p = job("balance", "cap classes of labelled windows", "input", "output")
    p.add_argument("--keep-normal-ratio", type=float, default=0.05)
    p.add_argument("--cap-initial-access", type=int, default=50_000)
    p = job("balance-active", "windows with traffic, capped normal class", "input", "output")
    p.add_argument("--budget", type=int, default=15_000)
    job("sequences", "balanced, scaled sequences and their scaler", "input", "output", "scaler")
    p = job("train", "fit the sequence baseline", "input", "output", "report")
    p.add_argument("--max-iter", type=int, default=1_000)
    p = job("evaluate", "evaluate a model on stored sequences", "input", "output")
    p.add_argument("--model")
    p.add_argument("--weights")
    p.add_argument("--scaler")
    p = job("score", "score windows with the sequence model", "input", "output", "weights", "scaler")
    p.add_argument("--step", type=int)
    p = job("risk", "labelled flows to risk windows", "input", "output")
    p.add_argument("--format", choices=["numeric", "positional"], default="numeric")
    p.add_argument("--window", type=int, default=10)
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = build_session(f"tideglass-{args.job}")

    def read(path: str):
        return spark.read.parquet(path)

    if args.job == "windows":
        flows = read_flow_log(spark, args.input)
        append_windows(
            jobs.build_windows(flows, args.window, args.by_file, not args.no_gap_fill), args.output
        )
    elif args.job == "label":
        truth = read_labelled_flows(spark, args.labels) if args.labels else None
        append_windows(jobs.label_windows(read(args.input).drop("day"), args.mode, truth), args.output)
    elif args.job == "balance":
        rows = jobs.balance(read(args.input), args.keep_normal_ratio, args.cap_initial_access)
        rows.write.parquet(args.output)
    elif args.job == "balance-active":
        jobs.balance_active_windows(read(args.input), args.budget).write.parquet(args.output)
    elif args.job == "sequences":
        sequences, scaler = jobs.build_sequences(read(args.input))
        sequences.write.parquet(args.output)
        scaler.save(spark, args.scaler)
    elif args.job == "train":
        model, results = jobs.train(read(args.input), args.max_iter)
        if model is None:
            raise SystemExit("only one class found, nothing to train")
        save_model(model, args.output)
        save_report(results["summary"], args.report)
    elif args.job == "evaluate":
        if args.weights:
            model = jobs.weights_from(spark, args.weights)
        elif args.model:
            model = LogisticRegressionModel.load(args.model)
        else:
            raise SystemExit("give --model or --weights")
        scaler = RobustScaler.load(spark, args.scaler) if args.scaler else None
        for name, table in evaluate(read(args.input), model, scaler).items():
            save_report(table, f"{args.output}/{name}")
    elif args.job == "score":
        scored = jobs.score_windows(
            read(args.input),
            jobs.weights_from(spark, args.weights),
            RobustScaler.load(spark, args.scaler),
            step=args.step,
        )
        scored.write.parquet(args.output)
    elif args.job == "risk":
        if args.format == "numeric":
            windows = jobs.risk_windows_numeric(read_numeric_flows(spark, args.input), args.window)
        else:
            windows = jobs.risk_windows_positional(
                read_positional_flows(spark, args.input), args.window
            )
        jobs.balanced_risk(windows).write.parquet(args.output)


if __name__ == "__main__":
    main()
