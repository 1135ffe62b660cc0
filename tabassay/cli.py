"""Command line: run, analyze, recommend, verify, statistics, voi."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from tabassay.config import default_config_path, load_config
from tabassay.constants import METHODS, PROFILE_NAMES, PROFILES

DEFAULT_RESULTS = "results/experiments/all_results.csv"


def session():
    from pyspark.sql import SparkSession

    from tabassay.session import prepare

    return prepare(SparkSession.builder.appName("tabassay").config("spark.sql.session.timeZone", "UTC").getOrCreate())


def parse_value_refs(text: str | None) -> dict | str | None:
    return text if text in (None, "auto") else json.loads(text)


def _results(path: str):
    from tabassay.sources.io import read_results

    if not Path(path).exists():
        raise FileNotFoundError(f"no results at {path}")
    return read_results(session(), str(Path(path).resolve()))


def cmd_run(args: argparse.Namespace) -> None:
    from tabassay.plans import experiment

    config = load_config(args.config or default_config_path())
    if args.sample_size:
        config.sample_size = args.sample_size
    experiment.run(session(), config, Path(args.output_dir), args.methods, args.n_replicates, args.n_synthetic, args.skip_measures, args.reset)


def cmd_analyze(args: argparse.Namespace) -> None:
    from tabassay.plans.plotdata import all_figures
    from tabassay.sources.io import write_table

    for name, df in all_figures(_results(args.results), parse_value_refs(args.value_refs)).items():
        write_table(df, str(Path(args.output_dir).resolve() / name), single_file=True)
        print(f"wrote {args.output_dir}/{name}")


def cmd_recommend(args: argparse.Namespace) -> None:
    from tabassay.plans.report import all_profiles, overview, recommendation

    if args.overview:
        print(overview(_results(args.results)))
        return
    if args.all:
        print(all_profiles(_results(args.results)))
        return
    if args.weights:
        weights, name = json.loads(args.weights), "Custom"
    elif args.profile in PROFILES:
        weights, name = PROFILES[args.profile], PROFILE_NAMES[args.profile]
    else:
        raise ValueError(f"unknown profile {args.profile}; known: {', '.join(PROFILES)}")
    print(recommendation(_results(args.results), weights, name))


def cmd_verify(args: argparse.Namespace) -> None:
    from tabassay.plans.report import verification

    print(verification(_results(args.results)))


def cmd_statistics(args: argparse.Namespace) -> None:
    from tabassay.plans.report import statistics

    print(statistics(_results(args.results)))


def cmd_voi(args: argparse.Namespace) -> None:
    from tabassay.plans.report import inflation, value_of_information, voi_latex

    if args.inflation:
        print(inflation(_results(args.results), args.n_simulations))
        return
    print((voi_latex if args.latex else value_of_information)(_results(args.results), args.n_simulations))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tabassay", description="Evaluate synthetic tables and choose between their generators.")
    sub = out.add_subparsers(dest="command")
    run = sub.add_parser("run", help="generate and measure")
    run.add_argument("--config")
    run.add_argument("--sample-size", type=int)
    run.add_argument("--n-synthetic", type=int)
    run.add_argument("--n-samples", dest="n_synthetic", type=int, help=argparse.SUPPRESS)
    run.add_argument("--n-replicates", type=int, default=5)
    run.add_argument("--methods", nargs="+", choices=METHODS)
    run.add_argument("--skip-measures", action="store_true")
    run.add_argument("--reset", action="store_true")
    run.add_argument("--output-dir", default="results/experiments")
    run.set_defaults(work=cmd_run)
    for name, work, about in (("analyze", cmd_analyze, "write the figures' data"), ("recommend", cmd_recommend, "rank methods"), ("verify", cmd_verify, "check published claims"), ("statistics", cmd_statistics, "statistical report"), ("voi", cmd_voi, "value of information")):
        one = sub.add_parser(name, help=about)
        one.add_argument("--results", default=DEFAULT_RESULTS)
        one.set_defaults(work=work)
    sub.choices["analyze"].add_argument("--output-dir", default="results/figures")
    sub.choices["analyze"].add_argument("--value-refs")
    sub.choices["recommend"].add_argument("--profile", default="balanced")
    sub.choices["recommend"].add_argument("--weights")
    sub.choices["recommend"].add_argument("--all", action="store_true", help="every profile")
    sub.choices["recommend"].add_argument("--overview", action="store_true", help="scores, normalised scores and every profile")
    sub.choices["voi"].add_argument("--inflation", action="store_true", help="how far the result depends on the inflation of uncertainty")
    sub.choices["voi"].add_argument("--n-simulations", type=int, default=50_000)
    sub.choices["voi"].add_argument("--latex", action="store_true")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if not args.command:
        parser().print_help()
        return 0
    try:
        args.work(args)
    except (FileNotFoundError, ValueError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
