"""Commands: ``python -m lineagelake.cli extract config.yaml`` and ``simulate config.yaml``."""

from __future__ import annotations

import argparse
import logging
from typing import Any

import yaml
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lineagelake.functions.storage import stored
from lineagelake.operators import simulate as S
from lineagelake.plans.extract import Config, ReadNumbers, extract
from lineagelake.sources import tables


LOG = logging.getLogger("lineagelake")


def run_extract(spark: SparkSession, settings: dict[str, Any]) -> None:
    """Counts of all samples: long, wide and annotated, below ``output_path``."""
    config = Config.of(settings["config"])
    out, numbers = settings["output_path"], ReadNumbers()
    LOG.info("extracting with %s", config)
    counts = stored(extract(spark, tables.read_sheet(spark, settings["input_csv"]), config, numbers), "extracted")
    for name, n in numbers.get().items():
        LOG.info("sample %s: %s", name, ", ".join(f"{v} {k}" for k, v in n.items()))
    tables.write_samples(counts, f"{out}/samples")
    for r in counts.groupBy("sample").agg(F.count("*").alias("n"), F.sum("counts").alias("all")).collect():  # one row a sample
        LOG.info("sample %s: %d barcodes, %d counts", r["sample"], r.n, r.all)
    tables.write_counts(counts, f"{out}/counts")
    tables.write_wide(counts, f"{out}/barcodes_output.csv")
    tables.write_annotated(counts, f"{out}/barcodes_output", "sample" if config.sequencing_technology == "DNA" else "cell")


def run_simulate(spark: SparkSession, settings: dict[str, Any]) -> None:
    """Reads and ground truth of the samples, below ``general.output_path``."""
    general, common = settings["general"], settings.get("common", {})
    out, names, seed = general["output_path"], list(general["samples"]), general.get("seed", 0)
    kinds = {"distribution_type": "kind", "counts": "count", "max_count": "high", "std_dev": "sd", "exponent": "a", "min_frequency": "least_percent"}
    fields = S.Counts.__dataclass_fields__
    given = {kinds.get(k, k): v for k, v in settings.get("distribution_params", {}).items()}
    counts = S.Counts(**{k: v for k, v in given.items() if k in fields})
    errors = {"chimeras": common.get("num_pcr_chimeras", 0), "fraction": common.get("pcr_error_fraction", 0.0), "substitutions": common.get("max_pcr_hamming_dist", 2)}
    length, flanks = common.get("sequence_length", 100), (common.get("flank_left") or "", common.get("flank_right") or "")
    if general.get("simulation_type") == "sc":
        sc = settings["sc"]
        cells = S.sc_molecules(
            spark, names, sc["num_cells"], sc["num_clones"], common.get("barcode_length", 16), sc.get("cell_bc_length", 16), sc.get("umi_length", 10),
            sc.get("umis_per_cell", 5), counts, seed=seed, **errors,
        ).cache()
        cells.dropDuplicates(["cell_bc"]).write.mode("overwrite").partitionBy("sample").csv(f"{out}/ground_truth", header=True)
        cells.select("cell_bc").distinct().write.mode("overwrite").csv(f"{out}/whitelist", sep="\t")
        for s in names:
            pair = S.sc_reads(cells.where(cells["sample"] == s), length, *flanks, seed=seed)
            for k in (1, 2):
                tables.write_fastq(pair, f"{out}/{s}_R{k}.fastq", f"read_{k}", ("read_1", "read_2"), seed + k)
        return
    dna = settings["dna"]
    truth = S.dna_ground_truth(
        spark, names, dna["num_barcodes"], common.get("barcode_length", 16), counts, common.get("min_hamming_dist", 0), seed=seed, **errors
    ).cache()
    truth.write.mode("overwrite").partitionBy("sample").csv(f"{out}/ground_truth", header=True)
    for s in names:
        own = truth.where(truth["sample"] == s)
        if common.get("art"):
            tables.write_fasta(own, f"{out}/{s}.fasta")
        else:
            tables.write_fastq(S.dna_reads(own, length, *flanks, seed=seed), f"{out}/{s}_R1.fastq", seed=seed)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lineagelake", description=__doc__)
    parser.add_argument("command", choices=["extract", "simulate"])
    parser.add_argument("config")
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO)
    with open(given.config) as f:
        settings = yaml.safe_load(f)
    spark = SparkSession.builder.appName(f"lineagelake-{given.command}").getOrCreate()
    (run_extract if given.command == "extract" else run_simulate)(spark, settings)


if __name__ == "__main__":
    main()
