"""Reports and guards over small results; only summaries are collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def markdown(frame: DataFrame, columns: list[str], digits: int = 3, most: int = 1000) -> str:
    """A table of a summary; more rows than ``most`` are an error, not a cut."""
    rows = frame.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *["| " + " | ".join(map(cell, r)) + " |" for r in rows]])


def require_map_rate(mapped: DataFrame, least: float = 0.99) -> float:
    """The share of answers (start_sent) that lie in a sentence; too few are an error."""
    rate = mapped.agg(F.avg(F.col("start_sent").isNotNull().cast("int"))).first()[0]
    if rate is None or rate < least:
        raise ValueError(f"map rate {rate} is below {least}")
    return rate


def comparable(ours: dict, theirs: dict, keys: tuple[str, ...] = ("reader", "retrieval", "data", "splits", "questions")) -> None:
    """Runs may be compared only if these parts of their configurations are equal."""
    apart = [k for k in keys if ours.get(k) != theirs.get(k)]
    if apart:
        raise ValueError(f"runs differ in {', '.join(apart)}")


def as_json(frame: DataFrame, most: int = 1000) -> str:
    """A summary as a list of JSON objects; more rows than ``most`` are an error, not a cut."""
    rows = [r[0] for r in frame.select(F.to_json(F.struct("*"))).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    return "[" + ",\n".join(rows) + "]"


def graph_report(built: dict[str, DataFrame], top: int = 15) -> list[str]:
    """Lines about a graph: counts of concepts by kind and of edges by type, vetoes, blocked merges, the largest concepts and the hubs."""
    counts = lambda frame, by: {r[by]: r["count"] for r in frame.groupBy(by).count().orderBy(by).collect()}
    degree = built["edges"].select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    hubs = built["concepts"].join(degree, F.concat(F.lit("c"), F.col("root")) == degree["node"]).orderBy(F.desc("degree"), "root").limit(top).collect()
    large = built["concepts"].orderBy(F.desc("n_mentions"), "root").limit(top).collect()
    return [
        f"- concepts: {counts(built['concepts'], 'kind')}", f"- edges: {counts(built['edges'], 'type')}", f"- vetoed string groups: {built['vetoed'].count()}", f"- blocked merges: {built['blocked'].count()}",
        *[f"- {r.n_mentions} mentions: {r.aliases}" for r in large], *[f"- degree {r.degree}: {r['name']} ({r.kind})" for r in hubs],
    ]


def merge_report(mentions: DataFrame, exact: DataFrame, alias: DataFrame, meaning: dict[float, DataFrame], sample: int = 10) -> list[str]:
    """Lines about the merge tiers: nodes after each, and a sample of alias merges, those of the lowest digest; meaning has (id, root) for each threshold."""
    nodes = exact.select("root").distinct()
    short = exact.withColumnsRenamed({"mid": "short", "root": "from"}).join(alias, "short").select("from", "short", "long", "rule")
    lines = [f"- mentions: {mentions.count()}", f"- nodes after equal strings: {nodes.count()}", f"- alias merges: {short.select('from').distinct().count()}"]
    text = mentions.select("mid", "text")
    shown = short.join(text.withColumnsRenamed({"mid": "short", "text": "said"}), "short").join(text.withColumnsRenamed({"mid": "long", "text": "whole"}), "long")
    lines += [f"- {r.said!r} -> {r.whole!r} ({r.rule})" for r in shown.orderBy(F.md5(F.concat("short", "long")), "short").limit(sample).collect()]
    return lines + [f"- nodes by meaning at {tau}: {frame.select('root').distinct().count()} of {frame.count()}" for tau, frame in sorted(meaning.items())]


def plot(points: dict[str, list[tuple[float, float]]], path: str, title: str) -> None:
    """Lines of a summary as a picture, where the package for it is at hand."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError as e:
        raise ValueError("pictures cannot be drawn here") from e
    figure, axes = pyplot.subplots()
    for name, line in sorted(points.items()):
        axes.plot(*zip(*sorted(line)), marker="o", label=name)
    axes.set_title(title)
    axes.legend()
    figure.savefig(path)
    pyplot.close(figure)
