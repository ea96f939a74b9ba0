"""Queries over the test tables, one or more for each operator of the inventory. Each takes (session, folder)."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom import schemas
from lexiloom.functions import text
from lexiloom.operators import extract, index, morph, vocab
from lexiloom.session import shared_dir
from lexiloom.sources import corpus, sinks

Query = Callable[[SparkSession, str], DataFrame]

#: Lemmas whose regular forms make the lexicon of the queries; any (word, lemma) table may stand in its place. The lemma model that the
#: reference loads is a trained one that isn't to be had.
LEMMAS = {
    "nom": "article banc base batterie bulletin calculateur capteur catalyseur centre chaîne chercheur composite couche culture dispositif donnée drone équipe étude fibre filière filtre ingénieur laboratoire laser lentille logiciel machine matériau membrane mesure méthode microscope module molécule moteur mousse pile plateforme polymère prix procédé programme projet protéine protocole prototype puce réacteur recherche réseau résine robot satellite simulation sonde spécialiste station structure surface système technique technologie traitement turbine vaccin véhicule",
    "adjectif": "autonome chimique durable fiable flexible hybride magnétique mobile numérique optique rapide recyclable réversible robuste sensible souple stable thermique",
    "verbe": "accélérer améliorer analyser compléter contrôler détecter espérer exploiter favoriser identifier limiter optimiser prolonger protéger recycler remplacer simuler stabiliser transformer",
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return corpus.latest(table(spark, d, "corpus"), "article")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return corpus.latest(table(spark, d, "bulletins").select("path", "html", "loaded_at"), "path")


def toks(spark: SparkSession, d: str) -> DataFrame:
    return index.tokenise(docs(spark, d))


def freq(spark: SparkSession, d: str) -> DataFrame:
    return index.tf(toks(spark, d))


def weights(spark: SparkSession, d: str) -> DataFrame:
    return index.tfidf(freq(spark, d))


def lexicon(spark: SparkSession) -> DataFrame:
    rows = [(w, kind) for kind, ws in LEMMAS.items() for w in ws.split()]
    return morph.inflected(spark.createDataFrame(rows, "lemma string, kind string"))


def rules(spark: SparkSession, d: str) -> DataFrame:
    return vocab.rules(table(spark, d, "substitutions"))


def stop(spark: SparkSession, d: str) -> DataFrame:
    return vocab.antidictionary(freq(spark, d))


def _flat(x: DataFrame) -> DataFrame:
    """Images as text, for comparison."""
    pairs = F.transform("images.image", lambda i: F.concat_ws("|", F.coalesce(i["urlimage"], F.lit("")), F.coalesce(i["legendeimage"], F.lit(""))))
    return x.withColumn("images", F.array_join(pairs, ";"))


def _stored_tf(spark: SparkSession, d: str) -> DataFrame:
    return index.stored_tf(table(spark, d, "tokens"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return extract.pages(pages(spark, d)).withColumn("article", extract.stem(F.col("path")))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return extract.documents(pages(spark, d))


def _file(spark: SparkSession) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/files-{spark.sparkContext.applicationId}/{uuid4().hex}"


def _tsv(relation: Query, schema: T.StructType, padded: bool = False) -> Query:
    """A relation written as TSV and read back: clean cells by tabs, padded ones by white space."""

    def run(s: SparkSession, d: str) -> DataFrame:
        at = _file(s)
        sinks.write_tsv(relation(s, d), at, padded)
        return (corpus.read_words if padded else corpus.read_tsv)(s, at, schema)

    return run


def _page_files(s: SparkSession, d: str) -> DataFrame:
    at = _file(s)
    sinks.write_pages(pages(s, d), at)
    return corpus.read_pages(s, at).select(extract.stem(F.col("path")).alias("article"), "html")


def _stop_lines(s: SparkSession, d: str) -> DataFrame:
    at = _file(s)
    sinks.write_lines(stop(s, d), at, "\t")
    return corpus.read_substitutions(s, at).select("word", "replacement")


def _substitution_file(s: SparkSession, d: str) -> DataFrame:
    at = _file(s)
    # one file, as line numbers order rules that contradict each other
    ordered = table(s, d, "substitutions").where("word is not null").select("line_no", "word", "replacement").coalesce(1).sortWithinPartitions("line_no")
    sinks.write_tsv(ordered.select("word", "replacement"), at)
    return vocab.rules(corpus.read_substitutions(s, at))


def _xml(s: SparkSession, d: str, relation: DataFrame, read: Callable[[SparkSession, str], DataFrame], one_file: bool = False) -> DataFrame:
    at = _file(s)
    sinks.write_corpus_xml(relation, at, one_file)
    return read(s, at)


def _readable(x: DataFrame) -> DataFrame:
    """Fields that a file can't tell from missing ones count as missing: empty ones."""
    return x.select(*(F.nullif(F.col(c), F.lit("")).alias(c) for c in x.columns))


_TEXTS = ("date", "bulletin", "article", "titre", "rubrique", "texte", "auteur", "contacts")


def _one_file(s: SparkSession, d: str) -> DataFrame:
    """The whole corpus as one file of documents in order; only for collections that one task can write."""
    at = _file(s)
    docs(s, d).select("article", sinks.document_xml().alias("xml")).repartition(1).sortWithinPartitions("article").select("xml").write.text(at)
    lines = s.read.text(at)
    return lines.agg(F.lit(len(lines.inputFiles())).cast("bigint").alias("files"), F.count(F.lit(1)).alias("lines"))


QUERIES: dict[str, Query] = {
    # tokenisation
    "tokens": toks,
    "token_counts_per_doc": lambda s, d: docs(s, d).select("article", F.size(text.tokens("titre", "texte")).alias("n_tokens")),
    "stored_tokens": lambda s, d: index.stored_tokens(table(s, d, "tokens")),
    "whitespace_words": lambda s, d: docs(s, d).select("article", F.posexplode(text.words(F.concat_ws(" ", "titre", "texte"))).alias("pos", "word")),
    "alpha_words": lambda s, d: morph.alpha_words(docs(s, d)),
    # frequencies and weights
    "tf": freq,
    "stored_tf": _stored_tf,
    "doc_count": lambda s, d: index.doc_count(freq(s, d)),
    "df": lambda s, d: index.df(freq(s, d)),
    "idf": lambda s, d: index.idf(freq(s, d)),
    "idf_raw": lambda s, d: index.idf(freq(s, d), None).withColumn("idf", F.round("idf", 10)),
    "tfidf": weights,
    "tfidf_by_token": lambda s, d: weights(s, d).select("token", "article", "w"),
    "tfidf_band_counts": lambda s, d: index.band_counts(weights(s, d)),
    "out_of_band": lambda s, d: weights(s, d).where((F.col("w") < vocab.LOW) | (F.col("w") > vocab.HIGH)),
    "postings": lambda s, d: index.postings(freq(s, d)).select("token", F.array_join("articles", " ").alias("articles")),
    "posting_blocks": lambda s, d: index.posting_blocks(freq(s, d)).select("token", F.explode("articles").alias("article")),
    "forward_index": lambda s, d: index.forward(toks(s, d)).select("article", F.array_join("tokens", " ").alias("tokens")),
    "series_all": lambda s, d: index.series(weights(s, d)),
    "series_doc": lambda s, d: index.series(weights(s, d), docs(s, d).agg(F.min("article")).scalar()),
    # anti-dictionary, substitution, sub-corpora
    "antidictionary": stop,
    "stop_filter": lambda s, d: vocab.exclude(toks(s, d), stop(s, d)),
    "substitution_rules": rules,
    "substitute_words": lambda s, d: vocab.substitute(docs(s, d).select("article", "texte"), rules(s, d)),
    "corpus_filtered": lambda s, d: _flat(vocab.filter_corpus(docs(s, d), vocab.stop_rules(stop(s, d)))).drop("loaded_at"),
    "corpus_substituted": lambda s, d: _flat(vocab.filter_corpus(docs(s, d), rules(s, d))).select("article", "titre", "rubrique", "texte", "images"),
    "subcorpus_titre": lambda s, d: vocab.subcorpus(docs(s, d), "titre"),
    "subcorpus_rubrique": lambda s, d: vocab.subcorpus(docs(s, d), "rubrique"),
    # extraction from pages
    "page_date": lambda s, d: _documents(s, d).select("article", "date"),
    "page_date_nbsp": lambda s, d: _parsed(s, d).select("article", extract.date_nbsp(F.col("page.title")).alias("date")),
    "page_titre": lambda s, d: _documents(s, d).select("article", "titre"),
    "page_bulletin": lambda s, d: _documents(s, d).select("article", "bulletin"),
    "article_stem": lambda s, d: pages(s, d).select("path", extract.stem(F.col("path")).alias("article")),
    "page_rubrique": lambda s, d: _documents(s, d).select("article", "rubrique"),
    "page_texte": lambda s, d: _documents(s, d).select("article", "texte"),
    "page_texte_in_order": lambda s, d: extract.documents(pages(s, d), reverse=False).select("article", "texte"),
    "page_auteur": lambda s, d: _documents(s, d).select("article", "auteur"),
    "page_meta_auteur": lambda s, d: extract.meta_author(pages(s, d)),
    "page_images": lambda s, d: extract.images(_documents(s, d)),
    "page_contacts": lambda s, d: _documents(s, d).select("article", "contacts"),
    "page_contact_auteur": lambda s, d: _parsed(s, d).select("article", extract.contact_author(F.col("page.spans")).alias("auteur")),
    "page_spans": lambda s, d: extract.spans(pages(s, d)),
    "page_documents": lambda s, d: _flat(_documents(s, d)).withColumnRenamed("_error", "failed"),
    # documents
    "corpus_document": lambda s, d: _flat(docs(s, d)).drop("loaded_at"),
    "corpus_images": lambda s, d: extract.images(docs(s, d)),
    "corpus_xml": lambda s, d: docs(s, d).select("article", sinks.document_xml().alias("xml")),
    # files: written, read back
    "file_pages": _page_files,
    "file_tokens": _tsv(toks, schemas.TOKENS),
    "file_tf": _tsv(freq, schemas.TF),
    "file_tf_padded": _tsv(freq, schemas.TF, padded=True),
    "file_idf": _tsv(lambda s, d: index.idf(freq(s, d)), schemas.IDF),
    "file_tfidf_padded": _tsv(weights, schemas.TFIDF, padded=True),
    "file_stop_lines": _stop_lines,
    "file_substitutions": _substitution_file,
    "file_corpus": lambda s, d: _readable(_xml(s, d, docs(s, d).select(*_TEXTS), lambda s, at: corpus.read_corpus_xml(s, at).select(*_TEXTS))),
    "file_corpus_tolerant": lambda s, d: _readable(_xml(s, d, docs(s, d).select(*_TEXTS), corpus.read_corpus_tolerant)),
    "file_corpus_filtered": lambda s, d: _readable(_xml(s, d, vocab.filter_corpus(docs(s, d), vocab.stop_rules(stop(s, d))).select(*_TEXTS), lambda s, at: corpus.read_corpus_xml(s, at).select(*_TEXTS))),
    "file_subcorpus": lambda s, d: _readable(_xml(s, d, vocab.subcorpus(docs(s, d), "titre"), lambda s, at: corpus.read_corpus_xml(s, at, schemas.SUBCORPUS_TITRE))),
    "corpus_one_file": _one_file,
    # morphology and reports
    "stem_fr": lambda s, d: morph.stems(morph.alpha_words(docs(s, d))),
    "lemma_dict": lambda s, d: morph.lemmas(morph.alpha_words(docs(s, d)), lexicon(s)),
    "useful_words": lambda s, d: morph.useful_words(docs(s, d), lexicon(s)),
    "vocab_report": lambda s, d: morph.report(morph.lemmas(morph.alpha_words(docs(s, d)), lexicon(s))),
    "vocab_distribution": lambda s, d: morph.distribution(morph.lemmas(morph.alpha_words(docs(s, d)), lexicon(s))),
    "stem_report": lambda s, d: morph.report(morph.stems(morph.alpha_words(docs(s, d)))),
}
