"""Page content streams as rows of operators, by patterns alone.

A stream is cut into tokens inside one expression; tokens become rows, and operands belong to the operator that follows
them. So a page of any length is spread over tasks, and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.operators.scans import running

_STRING = r"\((?:\\[\s\S]|[^\\()]++|\((?:\\[\s\S]|[^\\()]++|\((?:\\[\s\S]|[^\\()]++)*+\))*+\))*+\)"
_HEX = r"<[0-9A-Fa-f\s]*+>"
#: Comments, inline images, strings, dictionary brackets, hexadecimal strings, arrays, names, and all other words.
TOKEN = rf"%[^\r\n]*+|\bBI\s[\s\S]*?\sEI(?=\s|$)|{_STRING}|<<|>>|{_HEX}|\[(?:{_STRING}|{_HEX}|[^\[\]()<>])*+\]|/[^\s()<>\[\]{{}}/%]*+|[^\s()<>\[\]{{}}/%]++"
OPERATOR = r"^(?:BI\s[\s\S]*|(?!true$|false$|null$)[A-Za-z'\"][A-Za-z0-9*'\"]*)$"


def well_formed(content: Column) -> Column:
    """Whether a stream is tokens and white space only; null streams are not."""
    return F.coalesce(~F.regexp_replace(content, TOKEN, "").rlike(r"\S"), F.lit(False))


def stream_operators(pages: DataFrame, page: str, content: str) -> DataFrame:
    """A row per operator: page, pos (from 0), op and args, its operands as written.

    Malformed and null streams give no rows. An inline image is one operator BI without operands. Operands that no operator
    follows are left out. Streams are text of one byte a character.
    """
    good = pages.select(F.col(page).alias("page"), F.col(content).alias("s")).where(well_formed(F.col("s")))
    tokens = good.select("page", F.posexplode(F.regexp_extract_all("s", F.lit(TOKEN), F.lit(0))).alias("at", "token")).where(~F.col("token").startswith("%"))
    marked = tokens.withColumn("is_op", F.col("token").rlike(OPERATOR))
    numbered = running(marked, ["page"], "at", pos=("sum_before", F.col("is_op").cast("bigint")))
    whole = numbered.groupBy("page", "pos").agg(F.array_sort(F.collect_list(F.struct("at", "token", "is_op"))).alias("t"))
    last = F.element_at("t", -1)
    args = F.transform(F.filter("t", lambda x: ~x["is_op"]), lambda x: x["token"])
    op = F.when(last["token"].startswith("BI"), "BI").otherwise(last["token"])
    return whole.where(last["is_op"]).select("page", "pos", op.alias("op"), args.alias("args"))


def written(op: Column, args: Column) -> Column:
    """An operator as it stands in a stream."""
    return F.concat_ws(" ", args, op)


def matrices(operators: DataFrame) -> DataFrame:
    """Operators with m, the operands of a cm of six; null where one is no number. A cm of more or fewer does nothing."""
    six = F.transform("args", lambda x: x.try_cast("double"))
    whole = (F.col("op") == "cm") & (F.size("args") == 6)
    op = F.when((F.col("op") == "cm") & ~whole, "cm?").otherwise(F.col("op"))
    return operators.select("page", "pos", op.alias("op"), F.when(whole & F.forall(six, lambda x: x.isNotNull()), six).alias("m"))
