"""Command lines of the programs: python -m orrery.cli fit | analyze | temporal | holdout | write-table.

What set chunk sizes, loading threads and devices elsewhere is Spark's configuration here.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from orrery.sources import schema as S


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = out.add_subparsers(dest="command", required=True)
    fit = commands.add_parser("fit", help="sample a token table and fit subspaces")
    fit.add_argument("--src", required=True, help="token table (see write-table)")
    fit.add_argument("--out", default="subspace_out", help="run folder")
    fit.add_argument("--num-files", type=int, default=1500)
    fit.add_argument("--files-from", default=None, help="a manifest whose files are taken again, in place of --num-files")
    fit.add_argument("--tokens-per-file", type=int, default=S.N_CELLS)
    fit.add_argument("--clusters", "-K", type=int, default=64)
    fit.add_argument("--dim", "-d", type=int, default=16, help="directions of a cluster; 0 is k-means")
    fit.add_argument("--iters", type=int, default=25)
    fit.add_argument("--tol", type=float, default=1e-3, help="stop when fewer labels change")
    fit.add_argument("--linear", action="store_true", help="subspaces through the origin")
    fit.add_argument("--seed", type=int, default=0)
    fit.add_argument("--min-count", type=int, default=None, help="tokens under which a cluster is seeded again (twice --dim, at least 64)")
    fit.add_argument("--features", type=int, default=S.DIM)
    fit.add_argument("--cells", type=int, default=S.N_CELLS, help="tokens of a file")
    fit.add_argument("--files-total", type=int, default=None, help="files are 0 to this number; all of the table if not given")
    fit.add_argument("--files-per-folder", type=int, default=1)
    fit.add_argument("--max-ram-gb", type=float, default=None, help="fail if the sample takes more at half precision")
    analyze = commands.add_parser("analyze", help="report of a run folder")
    analyze.add_argument("--dir", default="subspace_out")
    analyze.add_argument("--out", default=None)
    analyze.add_argument("--top-pairs", type=int, default=12)
    months = commands.add_parser("temporal", help="report by months, and maps")
    months.add_argument("--dir", default="subspace_out")
    months.add_argument("--out", default=None)
    months.add_argument("--top-seasonal", type=int, default=8)
    months.add_argument("--coastlines", default=None, help="GeoJSON file of outlines")
    months.add_argument("--no-coastlines", action="store_true")
    months.add_argument("--no-heatmap", action="store_true")
    held = commands.add_parser("holdout", help="the frozen model on files it wasn't fitted to")
    held.add_argument("--dir", required=True)
    held.add_argument("--src", default=None)
    held.add_argument("--num-files", type=int, default=200)
    held.add_argument("--seed", type=int, default=12345)
    held.add_argument("--max-ram-gb", type=float, default=None)
    table = commands.add_parser("write-table", help="tokens (file_id, cell_id, features) as a table in folders by file")
    table.add_argument("--src", required=True)
    table.add_argument("--out", required=True)
    table.add_argument("--files-per-folder", type=int, default=1)
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    """What a program says at its end."""
    from orrery.operators import programs
    from orrery.sources.load import write_token_table

    ram = int(args.max_ram_gb * 1e9) if getattr(args, "max_ram_gb", None) is not None else None
    if args.command == "fit":
        load = S.LoadConfig(args.num_files, args.tokens_per_file, args.seed, args.features, args.cells, args.files_total, args.files_from, args.files_per_folder, ram)
        model = programs.fit_run(spark, args.src, load, S.FitConfig(args.clusters, args.dim, args.iters, args.tol, args.seed, args.linear, args.min_count), args.out)
        return f"{len(model.history)} rounds, objective/token {model.final_obj_per_token:.4f}, run folder {args.out}"
    if args.command == "analyze":
        return programs.analyze_run(spark, S.AnalyzeConfig(args.dir, args.out, args.top_pairs))
    if args.command == "temporal":
        return programs.temporal_run(spark, S.TemporalConfig(args.dir, args.out, args.top_seasonal, None if args.no_coastlines else args.coastlines, not args.no_heatmap))
    if args.command == "holdout":
        return json.dumps(programs.holdout_run(spark, S.HoldoutConfig(args.dir, args.src, args.num_files, args.seed, ram)), indent=2)
    write_token_table(spark.read.parquet(args.src), args.out, args.files_per_folder)
    return f"token table {args.out}"


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName(f"orrery {args.command}").getOrCreate()
    try:
        print(run(spark, args))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
