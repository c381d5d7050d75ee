"""The driver's tables seen as sequences, reads and run metadata, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions import dna
from strandwise.session import table

#: Length of a window and filter lengths (log 2) in use, for the queries of the catalog.
K = 11
SHORTEST, LONGEST = 18, 32


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def sequences(self, name: str, key: str) -> DataFrame:
        """(id, seq) of a table with a text."""
        rows = self.table(name).where("text is not null").select(F.col(key).alias("id"), "text")
        # windows are many times the text: a table in fewer parts than there are cores is spread before they are made
        cores = self.spark.sparkContext.defaultParallelism
        rows = rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
        return rows.select("id", dna.from_letters(F.col("text")).alias("seq"))

    @property
    def runs_seq(self) -> DataFrame:
        return self.sequences("documents", "doc_id")

    @property
    def items(self) -> DataFrame:
        return self.sequences("benchmark", "item_id")

    @property
    def broken(self) -> DataFrame:
        """(id, turn, seq) of the conversations, each gap between words an N."""
        seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]+", "N"), dna.LETTERS, dna.BASES_OF_LETTERS)
        return self.table("conversations").where("text is not null").select(F.col("conv_id").cast("string").alias("id"), "turn", seq.alias("seq"))

    @property
    def reads(self) -> DataFrame:
        rows = self.table("conversations").where("text is not null")
        return rows.select(F.col("conv_id").cast("string").alias("accession"), F.col("turn").alias("read_index"), F.lit(0).alias("read_subindex"), dna.from_letters(F.col("text")).alias("seq"))

    @property
    def runs(self) -> DataFrame:
        """Run metadata from documents."""
        d = self.table("documents")
        text = lambda c: F.lit(None).cast("string").alias(c)
        return d.select(
            F.concat(F.lit("DRR"), F.lpad((F.col("doc_id") + 1).cast("string"), 9, "0")).alias("run_accession"),
            F.concat(F.lit("EXP"), F.col("doc_id").cast("string")).alias("experiment_accession"),
            text("experiment_title"),
            text("experiment_design_description"),
            text("experiment_library_name"),
            F.col("lang").alias("experiment_library_strategy"),
            F.col("source").alias("experiment_library_source"),
            text("experiment_library_selection"),
            text("experiment_instrument_model"),
            F.concat(F.lit("SMP"), (F.col("doc_id") % 97).cast("string")).alias("sample_accession"),
            text("sample_taxa"),
            F.create_map(F.lit("Center"), F.coalesce("source", F.lit("none"))).alias("sample_attributes"),
            F.concat(F.lit("STU"), (F.col("doc_id") % 13).cast("string")).alias("study_accession"),
            text("study_title"),
            text("study_abstract"),
            F.expr("coalesce(n_chars, 0) div 100").cast("long").alias("number_of_spots"),
            F.coalesce("n_chars", F.lit(0)).cast("long").alias("number_of_bases"),
            F.date_add(F.lit("2010-01-01").cast("date"), (F.col("doc_id") % 3650).cast("int")).alias("date_received"),
        )

    @property
    def experiments(self) -> DataFrame:
        empty = lambda c: F.lit("").alias(c)
        rows = self.table("labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        return rows.select(
            F.concat(F.lit("EXP"), F.col("doc_id").cast("string")).alias("experiment_accession"),
            (F.col("toxic") == 0).alias("valid"),
            F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("experiment_title"),
            F.lit("labelled").alias("experiment_design_description"),
            *[empty(c) for c in ("experiment_library_name", "experiment_library_strategy", "experiment_library_source", "experiment_library_selection", "experiment_instrument_model")],
        )

    @property
    def samples(self) -> DataFrame:
        n = self.table("nation")
        pairs = F.create_map(F.lit("Center"), F.concat(F.lit("c"), F.col("n_regionkey").cast("string")), F.lit("nation"), F.col("n_name"))
        return n.select(F.concat(F.lit("SMP"), F.col("n_nationkey").cast("string")).alias("sample_accession"), F.col("n_name").alias("sample_taxa"), F.when(F.col("n_nationkey") % 2 == 0, pairs).alias("sample_attributes"))

    @property
    def studies(self) -> DataFrame:
        r = self.table("region")
        return r.select(F.concat(F.lit("STU"), F.col("r_regionkey").cast("string")).alias("study_accession"), F.col("r_name").alias("study_title"), F.lit("").alias("study_abstract"))

    @property
    def status(self) -> DataFrame:
        o = self.table("orders")
        return o.select(F.concat(F.lit("DRR"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("run_accession"), (F.col("o_orderkey") % 30 + 1).cast("int").alias("status"))


def seq_sql(table_name: str, key: str) -> str:
    return f"SELECT {key} AS id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{dna.LETTERS}', '{dna.BASES_OF_LETTERS}') AS seq FROM {table_name} WHERE text IS NOT NULL"


def windows_sql(source: str, k: int = K, columns: str = "id") -> str:
    """All canonical windows of a relation (id, seq) without broken bases."""
    inner = f"SELECT {columns}, substring(seq, i, {k}) AS w FROM (SELECT {columns}, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM {source} WHERE length(seq) >= {k})"
    return f"SELECT {columns}, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS kmer FROM ({inner})"


RUNS_SQL = """SELECT 'DRR' || lpad((doc_id + 1)::VARCHAR, 9, '0') AS run_accession, 'EXP' || doc_id AS experiment_accession, NULL::VARCHAR AS experiment_title,
 lang AS experiment_library_strategy, source AS experiment_library_source, 'SMP' || (doc_id % 97) AS sample_accession, coalesce(source, 'none') AS center,
 'STU' || (doc_id % 13) AS study_accession, coalesce(n_chars, 0)::BIGINT // 100 AS number_of_spots, coalesce(n_chars, 0)::BIGINT AS number_of_bases,
 (DATE '2010-01-01' + (doc_id % 3650)::INT)::DATE AS date_received FROM documents"""


def murmur_sql(source: str, k: int, seeds: int, columns: str) -> str:
    """A relation with kmer and columns, and hash0, hash1, ... of kmer, for the WITH clause: chained steps over unsigned numbers."""
    mask, blocks, tail = "4294967295", k // 4, k % 4
    word = lambda at, n: " + ".join(f"(ascii(substring(kmer, {at + i + 1}, 1))::UBIGINT << {8 * i})" for i in range(n))
    rot = lambda x, n: f"((({x} << {n}) & {mask}) | ({x} >> {32 - n}))"
    n = blocks + (tail > 0)
    base = f"{columns}, kmer"
    steps = [f"SELECT {base}, " + ", ".join(f"(({word(4 * i, 4 if i < blocks else tail)}) * 3432918353) & {mask} AS b{i}" for i in range(n)) + f" FROM {source}"]
    steps.append(f"SELECT {base}, " + ", ".join(f"{rot(f'b{i}', 15)} AS b{i}" for i in range(n)) + " FROM {}")
    steps.append(f"SELECT {base}, " + ", ".join(f"(b{i} * 461845907) & {mask} AS b{i}" for i in range(n)) + ", " + ", ".join(f"{s}::UBIGINT AS h{s}" for s in range(seeds)) + " FROM {}")
    keep = ", ".join(f"b{i}" for i in range(n))
    for i in range(blocks):
        steps.append(f"SELECT {base}, {keep}, " + ", ".join(f"xor(h{s}, b{i}) AS h{s}" for s in range(seeds)) + " FROM {}")
        steps.append(f"SELECT {base}, {keep}, " + ", ".join(f"({rot(f'h{s}', 13)} * 5 + 3864292196) & {mask} AS h{s}" for s in range(seeds)) + " FROM {}")
    last = f"xor(xor(h{{s}}, b{n - 1}), {k}::UBIGINT)" if tail else f"xor(h{{s}}, {k}::UBIGINT)"
    steps.append(f"SELECT {base}, " + ", ".join(f"{last.format(s=s)} AS h{s}" for s in range(seeds)) + " FROM {}")
    for make in (lambda h: f"xor({h}, {h} >> 16)", lambda h: f"({h} * 2246822507) & {mask}", lambda h: f"xor({h}, {h} >> 13)", lambda h: f"({h} * 3266489909) & {mask}", lambda h: f"xor({h}, {h} >> 16)"):
        steps.append(f"SELECT {base}, " + ", ".join(f"{make(f'h{s}')} AS h{s}" for s in range(seeds)) + " FROM {}")
    sql = steps[0]
    for step in steps[1:]:
        sql = step.format(f"({sql})")
    return f"SELECT {columns}, kmer, " + ", ".join(f"h{s}::BIGINT AS hash{s}" for s in range(seeds)) + f" FROM ({sql})"


def params_sql(source: str, shortest: int = SHORTEST, longest: int = LONGEST) -> str:
    """(id, n_kmers, log_2_filter_len, num_hash) of a relation (id, n_kmers): the least error for the shortest length that meets 0.25."""
    grid = f"SELECT id, n_kmers, size, h, pow(1 - pow(1 - 1 / pow(2.0::DOUBLE, size), (n_kmers * h)::DOUBLE), h::DOUBLE) AS p FROM {source}, range({shortest}, {longest + 1}) a(size), range(1, 6) b(h) WHERE n_kmers > 0"
    fit = f"SELECT *, min(size) OVER (PARTITION BY id) AS first FROM ({grid}) WHERE p <= 0.25"
    return f"SELECT id, n_kmers, size::INT AS log_2_filter_len, h::INT AS num_hash FROM ({fit}) WHERE size = first QUALIFY row_number() OVER (PARTITION BY id ORDER BY p, h) = 1"
