"""Entities and decomposition against the standard library, over all of its cases."""

import html
import re
import unicodedata
from html.entities import html5

import pandas as pd
from pyspark.sql import functions as F

from mentionlake.functions.entities import unescape
from mentionlake.functions.folding import without_marks
from mentionlake.functions.text import folded_title


def run(spark, f, texts):
    rows = spark.createDataFrame(pd.DataFrame({"k": range(len(texts)), "t": texts}))
    return [r.x for r in rows.select("k", f(F.col("t")).alias("x")).orderBy("k").collect()]


def test_names(spark):
    texts = [t for name in html5 for t in (f"a&{name}b", f"&{name}", f"&{name};x")] + ["&", "&&amp;", "&amp;amp;", "&notit;", "&no;", "&ampx;", "&nosuchname;", "AT&T", "a & b", "&lt", "&ltx", "&#", "&#;", "&#x;", "&#xg;", ""]
    assert run(spark, unescape, texts) == [html.unescape(t) for t in texts]


def test_numbers(spark):
    codes = [*range(0x300), *range(0xD7F0, 0xE010), *range(0xFDC0, 0x10020), *range(0x1FFF0, 0x20010), *range(0x10FFF0, 0x110010), 10**9, 10**12, 2**64 + 65]
    texts = [t for c in codes for t in (f"&#{c};", f"a&#x{c:x}z", f"&#0{c}")]
    assert run(spark, unescape, texts) == [html.unescape(t) for t in texts]


def test_decomposition(spark):
    codes = [c for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    plain = ["".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)) for code in codes]
    assert run(spark, without_marks, [chr(c) for c in codes]) == plain
    assert run(spark, without_marks, ["ﬁm x² ＡＢ 한글 ação é", "🙂", ""]) == ["fim x2 AB " + unicodedata.normalize("NFKD", "한글") + " acao e", "🙂", ""]


def test_titles(spark):
    texts = ["O ﬁm da Ação: x², ok", "ＦＵＬＬ—Width", "  São  João! ", "½ Ⅳ"]

    def plain(t):
        t = "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", t)).strip()

    assert run(spark, folded_title, texts) == [plain(t) for t in texts]
