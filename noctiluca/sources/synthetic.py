"""The deterministic sample collection: six categories, made from word lists by modular arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The words and sentences of the sample collection.
PREFIXES = {
    "cs.CL": ["Transformer Retrieval", "Long-Context Language Models", "Citation-Aware Summarization", "Scientific Claim Verification", "Terminology Grounding"],
    "cs.CV": ["Microscopy Vision Transformers", "Cell Segmentation", "Remote Sensing Detection", "Radiology Image Classification", "Scientific Figure Parsing"],
    "cs.LG": ["Meta-Learning Optimizers", "Neural Operator Benchmarks", "Active Learning Loops", "Federated Scientific Models", "Probabilistic Representation Learning"],
    "physics.comp-ph": ["Lattice Simulation Surrogates", "Turbulence Solvers", "Plasma Dynamics Emulators", "Quantum Monte Carlo Acceleration", "Inverse Problems in Physics"],
    "physics.data-an": ["Detector Calibration Pipelines", "High-Energy Event Reconstruction", "Bayesian Measurement Uncertainty", "Sensor Drift Analysis", "Experimental Signal Denoising"],
    "stat.ML": ["Bayesian Hierarchical Models", "Causal Estimation under Shift", "Conformal Prediction for Science", "Experimental Design with Priors", "Robust Uncertainty Quantification"],
}
KEYWORDS = {
    "cs.CL": ["tokenization", "document retrieval", "question answering", "summarization", "citation context", "evidence ranking"],
    "cs.CV": ["image segmentation", "lesion detection", "microscopy", "satellite imagery", "object detection", "visual backbone"],
    "cs.LG": ["generalization", "hyperparameter search", "optimization", "representation learning", "uncertainty calibration", "benchmark suite"],
    "physics.comp-ph": ["partial differential equations", "simulation grid", "boundary conditions", "Hamiltonian system", "solver convergence", "numerical stability"],
    "physics.data-an": ["detector response", "measurement noise", "calibration curve", "event reconstruction", "instrument drift", "posterior intervals"],
    "stat.ML": ["posterior predictive checks", "coverage guarantees", "covariate shift", "causal effect", "credible intervals", "sampling efficiency"],
}
SHARED = {
    "cs.CL": ["benchmark", "embedding model", "generalization"],
    "cs.CV": ["benchmark", "feature extractor", "robustness"],
    "cs.LG": ["benchmark", "embedding model", "robustness"],
    "physics.comp-ph": ["benchmark", "simulation study", "generalization"],
    "physics.data-an": ["benchmark", "uncertainty", "robustness"],
    "stat.ML": ["benchmark", "uncertainty", "generalization"],
}
VENUES = {
    "cs.CL": ["ACL", "EMNLP", "NAACL"],
    "cs.CV": ["CVPR", "ICCV", "MICCAI"],
    "cs.LG": ["ICML", "NeurIPS", "ICLR"],
    "physics.comp-ph": ["PhysRevE", "JCP", "SciPost"],
    "physics.data-an": ["JINST", "PhysRevD", "NIMA"],
    "stat.ML": ["AISTATS", "JRSS-B", "JASA"],
}
DOMAINS = {
    "cs.CL": "language understanding",
    "cs.CV": "scientific imaging",
    "cs.LG": "machine learning methodology",
    "physics.comp-ph": "computational physics",
    "physics.data-an": "experimental physics analysis",
    "stat.ML": "statistical machine learning",
}
NEIGHBOURS = {
    "cs.CL": ["cs.LG", "stat.ML"],
    "cs.CV": ["cs.LG", "physics.data-an"],
    "cs.LG": ["cs.CL", "stat.ML"],
    "physics.comp-ph": ["physics.data-an", "cs.LG"],
    "physics.data-an": ["physics.comp-ph", "cs.CV"],
    "stat.ML": ["cs.LG", "cs.CL"],
}
GLOBAL_TERMS = ["benchmark", "dataset", "generalization", "embedding model", "evaluation", "transfer learning", "uncertainty", "robustness", "ablation", "scientific workflow"]
CROSS_TERMS = ["document retrieval", "representation learning", "image segmentation", "question answering", "optimization", "calibration curve", "simulation grid", "causal effect", "event reconstruction", "posterior intervals"]
PERFECT_TITLE = "%s for %s Study %d"
PERFECT_ABSTRACT = "We present a %1$s benchmark focused on %2$s and %3$s. The study evaluates reproducible baselines, ablations, and error analysis on %4$s style tasks. Results emphasize category-specific signals such as %2$s, %3$s, and deployment constraints typical for %1$s workflows."
TITLES = ["%1$s for %2$s Study %3$d", "%1$s: %4$s and %5$s", "Benchmarking %6$s in %2$s", "A Comparative Study of %4$s for Scientific Workflows"]
ABSTRACT = "We study %1$s for %2$s with comparisons against strong baselines and shared evaluation datasets. The paper discusses %3$s, %4$s, and %5$s on %6$s style tasks. Several experiments also touch on neighboring themes such as %7$s and %8$s, making label boundaries partially overlapping rather than perfectly clean. Results highlight transfer, uncertainty, and practical deployment tradeoffs in scientific workflows."
# end of fixed values


def _at(table: dict[str, list[str]] | list[str], index: Column, category: Column | None = None) -> Column:
    """Entry index mod length of a list, or of the list of a category."""
    lists = table if isinstance(table, dict) else {"": table}
    out = None
    for key, values in lists.items():
        entry = F.element_at(F.array(*map(F.lit, values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))
        if category is None:
            return entry
        out = F.when(category == key, entry) if out is None else out.when(category == key, entry)
    return out


def sample_papers(spark: SparkSession, per_category: int = 167, perfect: bool = False) -> DataFrame:
    """``per_category`` papers of each of the six categories, ids in order; ``perfect`` gives each category words of its
    own only. Made where it is used: a range and expressions, nothing is shipped from the driver."""
    names = list(PREFIXES)
    base = spark.range(per_category * len(names)).select((F.col("id") + 1).alias("paper_id"), F.expr(f"id % {per_category}").alias("i"), F.expr(f"cast(id div {per_category} as int)").alias("c"))
    cat = F.element_at(F.array(*map(F.lit, names)), F.col("c") + 1)
    base = base.withColumn("category", cat)
    category, i, c = F.col("category"), F.col("i"), F.col("c")
    number = i + 1
    word_a, word_b = _at(KEYWORDS, i, category), _at(KEYWORDS, i + 2, category)
    prefix, shared, venue = _at(PREFIXES, i, category), _at(SHARED, i, category), _at(VENUES, i, category)
    domain = _at({k: [v] for k, v in DOMAINS.items()}, i, category)
    year = 2020 + F.pmod(i + c, F.lit(6))
    if perfect:
        title = F.format_string(PERFECT_TITLE, prefix, F.initcap(word_a), number)
        abstract = F.format_string(PERFECT_ABSTRACT, category, word_a, word_b, venue)
    else:
        near = _at(KEYWORDS, i + 1, _at(NEIGHBOURS, i, category))
        general, cross = _at(GLOBAL_TERMS, i + c), _at(CROSS_TERMS, i * 2 + c)
        parts = (prefix, F.initcap(domain), number, F.initcap(word_a), F.initcap(cross), F.initcap(shared))
        style = F.pmod(i, F.lit(4))
        title = F.when(style == 0, F.format_string(TITLES[0], *parts)).when(style == 1, F.format_string(TITLES[1], *parts)).when(style == 2, F.format_string(TITLES[2], *parts)).otherwise(F.format_string(TITLES[3], *parts))
        abstract = F.format_string(ABSTRACT, word_a, domain, word_b, shared, general, venue, near, cross)
    stamp = F.concat(year.cast("string"), F.lit("-01-01T00:00:00Z"))
    return base.select("paper_id", title.alias("title"), abstract.alias("abstract"), "category", category.alias("primary_category"), F.lit("Synthetic Author et al.").alias("authors"), stamp.alias("published"), stamp.alias("updated"), F.lit("").alias("url"), year.cast("int").alias("year"))
