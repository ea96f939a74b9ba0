"""One explicit schema per relation; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


IMAGE = _struct(urlimage=S, legendeimage=S)
IMAGES = _struct(image=T.ArrayType(IMAGE))
PAGE = _struct(path=S, html=S)
DOCUMENT = _struct(date=S, bulletin=S, article=S, titre=S, rubrique=S, texte=S, auteur=S, contacts=S, images=IMAGES)
SUBCORPUS_TITRE = _struct(article=S, titre=S)
TOKENS = _struct(article=S, pos=I, token=S)
TF = _struct(article=S, token=S, tf=L)
IDF = _struct(token=S, df=L, idf=D)
TFIDF = _struct(article=S, token=S, w=D)
SUBSTITUTIONS = _struct(line_no=L, word=S, replacement=S)
REDUCTIONS = _struct(article=S, word=S, reduction=S)
#: What one pass over a page's HTML yields; `failed` is set when the content cell can't be reached.
PARSED = _struct(
    title=S, metas=T.ArrayType(S), spans=T.ArrayType(S), cell=T.ArrayType(_struct(cls=S, text=S)), images=T.ArrayType(IMAGE), failed=T.BooleanType()
)
