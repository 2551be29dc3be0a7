"""Reading and writing Turtle and N-Triples.

N-Triples are parsed line by line in parallel. A Turtle document is one unit,
as its prefixes and blank nodes are; several documents are parsed in parallel.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.parser import QueryError, unescape
from ..terms import BOOLEAN, CUSTOM, DECIMAL, DOUBLE, INTEGER, LANGUAGE, LITERAL, RDF, TAGS, URI, term_text
from .triples import COLUMNS, SCHEMA

Row = tuple[str, str, str, int, str | None]

_TOKEN = re.compile(
    r'''(?P<skip>\s+|\#[^\n]*)
  |(?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
  |(?P<long>"""(?:(?:"|"")?(?:[^"\\]|\\.))*"""|\'\'\'(?:(?:'|'')?(?:[^'\\]|\\.))*\'\'\')
  |(?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  |(?P<blank>_:[^\s<>"'()\[\]{},;.\#]+(?:\.+[^\s<>"'()\[\]{},;.\#]+)*)
  |(?P<number>[+-]?(?:[0-9]+\.[0-9]+|\.[0-9]+|[0-9]+)(?:[eE][+-]?[0-9]+)?)
  |(?P<name>[^\s<>"'()\[\]{},;.\#@:^]*:(?:[^\s<>"'()\[\]{},;.\#]|\.(?=[^\s<>"'()\[\]{},;.\#]))*)
  |(?P<word>[A-Za-z]+)
  |(?P<sign>\^\^|[.,;()\[\]])''',
    re.VERBOSE | re.DOTALL,
)


class TurtleError(ValueError):
    """Text that is no Turtle."""


class TurtleParser:
    """A recursive-descent parser. blank: what labels of this document begin with."""

    def __init__(self, text: str, base: str = "", blank: str = ""):
        self.text, self.at, self.base, self.blank = text, 0, base, blank
        self.prefixes: dict[str, str] = {}
        self.fresh, self.out = 0, []
        self.token = ("end", "")
        self.errors: list[str] = []

    def next(self) -> None:
        while self.at < len(self.text):
            m = _TOKEN.match(self.text, self.at)
            if not m:
                raise TurtleError(f"unexpected character {self.text[self.at]!r}")
            self.at = m.end()
            if m.lastgroup != "skip":
                self.token = (m.lastgroup, m[0])
                return
        self.token = ("end", "")

    def rows(self, recover: bool = False) -> Iterator[Row]:
        """All triples. recover: what can't be parsed is skipped up to the next line, and noted in ``errors``."""
        while True:
            began = self.at
            try:
                if not self.out:
                    self.next()
                if self.token[0] == "end":
                    return
                self.statement()
            except (TurtleError, QueryError) as e:
                if not recover:
                    raise TurtleError(f"{e} near {self.text[began : began + 60]!r}") from None
                self.errors.append(str(e))
                self.out.clear()
                line = self.text.find("\n", max(self.at, began + 1))
                if line < 0:
                    return
                self.at = line + 1
                continue
            yield from self.out
            self.out = []

    def sign(self, s: str) -> bool:
        return self.token == ("sign", s)

    def expect(self, s: str) -> None:
        if not self.sign(s):
            raise TurtleError(f"'{s}' expected, got '{self.token[1]}'")

    def statement(self) -> None:
        kind, text = self.token
        word = text.lower()
        if kind == "at" and word in ("@prefix", "@base") or kind == "word" and word in ("prefix", "base"):
            self.next()
            if word.endswith("prefix"):
                if self.token[0] != "name" or not self.token[1].endswith(":"):
                    raise TurtleError("a prefix is expected")
                name = self.token[1][:-1]
                self.next()
                self.prefixes[name] = self.iri()
            else:
                self.base = self.iri()
            if kind == "at":
                self.next()
                self.expect(".")
            return
        if self.sign("["):
            subject = self.brackets()
            if self.sign("."):
                return
        elif self.sign("("):
            subject = self.collection()
        else:
            subject = self.resource()
            self.next()
        self.properties(subject)
        self.expect(".")

    def iri(self) -> str:
        kind, text = self.token
        if kind != "iri":
            raise TurtleError("an IRI is expected")
        iri = unescape(text[1:-1])
        return urljoin(self.base, iri) if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri) else iri

    def resource(self) -> str:
        """The IRI or label of the current token."""
        kind, text = self.token
        if kind == "iri":
            return self.iri()
        if kind == "blank":
            return "_:" + self.blank + text[2:]
        if kind == "name":
            prefix, local = text.split(":", 1)
            if prefix not in self.prefixes:
                raise TurtleError(f"unknown prefix {prefix}:")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise TurtleError(f"unexpected '{text}'")

    def node(self) -> str:
        self.fresh += 1
        return f"_:{self.blank}b{self.fresh}"

    def brackets(self) -> str:
        """[ p o ; ... ]; ends behind the bracket."""
        subject = self.node()
        self.next()
        if not self.sign("]"):
            self.properties(subject)
            self.expect("]")
        self.next()
        return subject

    def collection(self) -> str:
        """( a b ... ); ends behind the bracket."""
        self.next()
        first = last = None
        while not self.sign(")"):
            if self.token[0] == "end":
                raise TurtleError("')' expected")
            cell = self.node()
            if last is None:
                first = cell
            else:
                self.out.append((last, RDF + "rest", cell, URI, None))
            self.out.append((cell, RDF + "first", *self.object()))
            last = cell
        self.next()
        if last is None:
            return RDF + "nil"
        self.out.append((last, RDF + "rest", RDF + "nil", URI, None))
        return first

    def properties(self, subject: str) -> None:
        while True:
            if self.token == ("word", "a"):
                predicate = RDF + "type"
            elif self.token[0] == "blank":
                raise TurtleError("a predicate can't be blank")
            else:
                predicate = self.resource()
            self.next()
            while True:
                self.out.append((subject, predicate, *self.object()))
                if not self.sign(","):
                    break
                self.next()
            if not self.sign(";"):
                return
            while self.sign(";"):
                self.next()
            if self.sign(".") or self.sign("]"):
                return

    def object(self) -> tuple[str, int, str | None]:
        """The object at the current token; ends behind it."""
        if self.sign("["):
            return self.brackets(), URI, None
        if self.sign("("):
            return self.collection(), URI, None
        kind, text = self.token
        if kind in ("string", "long"):
            value = unescape(text[3:-3] if kind == "long" else text[1:-1])
            self.next()
            if self.token[0] == "at":
                lang = self.token[1][1:]
                self.next()
                return value, LANGUAGE, lang
            if self.sign("^^"):
                self.next()
                datatype = self.resource()
                self.next()
                tag = TAGS.get(datatype)
                return (value, CUSTOM, datatype) if tag is None else (value, tag, None)
            return value, LITERAL, None
        if kind == "number":
            self.next()
            return text, DOUBLE if "e" in text.lower() else DECIMAL if "." in text else INTEGER, None
        if kind == "word" and text in ("true", "false"):
            self.next()
            return text, BOOLEAN, None
        out = self.resource()
        self.next()
        return out, URI, None


def parse_turtle(text: str, base: str = "", blank: str = "", recover: bool = False) -> list[Row]:
    return list(TurtleParser(text, base, blank).rows(recover))


def turtle_frame(spark: SparkSession, text: str, base: str = "", blank: str = "") -> DataFrame:
    """The triples of a document that is given as text."""
    return spark.createDataFrame(parse_turtle(text, base, blank), SCHEMA)


def read_turtle(spark: SparkSession, paths: str | list[str], base: str = "", recover: bool = True) -> DataFrame:
    """The triples of Turtle files, one task a file at most; duplicates may remain."""
    files = spark.read.text(paths, wholetext=True).select("value", F.crc32(F.input_file_name().cast("binary")).alias("tag"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, tag in zip(batch["value"], batch["tag"], strict=True):
                held: list[Row] = []
                for row in TurtleParser(text, base, f"f{tag:x}.").rows(recover):
                    held.append(row)
                    if len(held) >= 50_000:
                        yield pd.DataFrame(held, columns=COLUMNS)
                        held = []
                yield pd.DataFrame(held, columns=COLUMNS)

    return files.mapInPandas(run, SCHEMA)


_RESOURCE = r'(<[^<>"{}|^`\x00-\x20]*>|_:[^\s<>"]+)'
_LINE = r"^\s*" + _RESOURCE + r"\s*(<[^<>\s]*>)\s*(?:" + _RESOURCE + r'|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^<>\s]*)>)?)\s*\.\s*(?:#.*)?$'


def unescaped(col: Column, escapes: tuple[tuple[str, str], ...]) -> Column:
    """Escapes resolved by Spark functions: between pairs of backslashes a backslash begins an escape."""
    pieces = F.split(col, r"\\\\")

    def one(x: Column) -> Column:
        for raw, safe in escapes:
            x = F.replace(x, F.lit(safe), F.lit(raw))
        return x

    return F.when(F.contains(col, F.lit("\\")), F.array_join(F.transform(pieces, one), "\\")).otherwise(col)


def _unescaped(col: Column) -> Column:
    return unescaped(col, (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("'", "\\'")))


def read_ntriples(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The triples of N-Triples files, split by Spark; lines that are none are left out."""
    return ntriples_lines(spark.read.text(paths))


def ntriples_lines(lines: DataFrame) -> DataFrame:
    """(s, p, o_v, o_t, o_st) of a table with one column of lines."""
    line = F.col(lines.columns[0])
    parts = lines.where(F.rlike(line, F.lit(_LINE))).select(
        *[F.regexp_extract(line, _LINE, i + 1).alias(n) for i, n in enumerate(("s", "p", "r", "text", "lang", "dt"))], line.alias("line")
    )
    numeric = F.create_map(*[x for iri, tag in TAGS.items() for x in (F.lit(iri), F.lit(tag))])
    tag = (
        F.when(F.col("r") != "", F.lit(URI)).when(F.col("lang") != "", F.lit(LANGUAGE))
        .when(F.col("dt") == "", F.lit(LITERAL)).otherwise(F.coalesce(F.try_element_at(numeric, F.col("dt")), F.lit(CUSTOM)))
    )

    def bare(c: str) -> Column:
        return F.when(F.startswith(c, F.lit("<")), F.expr(f"substring({c}, 2, length({c}) - 2)")).otherwise(F.col(c))

    coded = unicode_escapes
    return parts.select(
        coded(bare("s")).alias("s"), coded(bare("p")).alias("p"),
        F.when(F.col("r") != "", coded(bare("r"))).otherwise(_unescaped(coded(F.col("text")))).alias("o_v"),
        tag.cast("tinyint").alias("o_t"),
        F.when(tag == LANGUAGE, F.col("lang")).when(tag == CUSTOM, F.col("dt")).alias("o_st"),
    )


def unicode_escapes(col: Column) -> Column:
    r"""\uXXXX and \UXXXXXXXX resolved; only texts that have one are split."""
    hexed = r"(?<!\\)((?:\\\\)*)\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})"
    marked = F.regexp_replace(col, hexed, "$1\x01$2\x02")
    pieces = F.split(marked, "\x01")

    def one(x: Column) -> Column:
        code = F.substring_index(x, "\x02", 1)
        number = F.conv(F.substring(code, 2, 8), 16, 10).cast("int")
        wide = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.concat(wide, F.substring(x, F.length(code) + 2, F.length(x)))

    resolved = F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), one), ""))
    return F.when(F.rlike(col, F.lit(hexed)), resolved).otherwise(col)


# writing


def object_text(df: DataFrame) -> Column:
    return term_text(F.struct(F.col("o_v").alias("v"), F.col("o_t").alias("t"), F.col("o_st").alias("st")))


def resource_text(col: str) -> Column:
    return F.when(F.startswith(col, F.lit("_:")), F.col(col)).otherwise(F.concat(F.lit("<"), F.col(col), F.lit(">")))


def ntriples(triples: DataFrame) -> DataFrame:
    """A line for each triple."""
    return triples.select(F.concat_ws(" ", resource_text("s"), resource_text("p"), object_text(triples), F.lit(".")).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriples(triples).write.text(path)


def turtle(triples: DataFrame) -> DataFrame:
    """Lines of Turtle: predicates and objects are grouped under their subject, which may span several lines."""
    lists = triples.select("s", "p", object_text(triples).alias("o")).groupBy("s", "p").agg(F.array_join(F.sort_array(F.collect_list("o")), " , ").alias("o"))
    pairs = lists.select("s", F.concat(resource_text("p"), F.lit(" "), F.col("o")).alias("po"))
    lines = pairs.groupBy("s").agg(F.array_join(F.sort_array(F.collect_list("po")), " ;\n  ").alias("body"))
    return lines.orderBy("s").select(F.concat(resource_text("s"), F.lit("\n  "), F.col("body"), F.lit(" .")).alias("value"))


def write_turtle(triples: DataFrame, path: str) -> None:
    turtle(triples).write.text(path)

