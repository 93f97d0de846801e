"""Block structure of Python as a relation: which lines a compound statement holds, by indentation, in the JVM.

Strings and comments are blanked first, then lines inside brackets are known by how many are open.  What remains are the
lines that begin statements.  A block ends before the first of these that is indented no deeper than its head (its own
elif, else, except and finally continue it): the nearest smaller indentation, found for all blocks of a file by one fold
with a stack.

A null code has no blocks; rows of other languages have none; equal file_ids are files of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.textops import indent, split_lines, strip

#: Words that begin a block, and those that continue the block of another head.
HEADS = "if|for|while|with|try|def|class"
GOES_ON = "elif|else|except|finally|case"
#: Strings of either length, and comments.  Possessive, so that a long string costs no stack.
LITERAL = r"""(?s)\"\"\"(?:[^\\"]++|\\.|"(?!""))*+(?:\"\"\"|\z)|'''(?:[^\\']++|\\.|'(?!''))*+(?:'''|\z)|"(?:[^\\"\n]++|\\.)*+["\n]?|'(?:[^\\'\n]++|\\.)*+['\n]?|#[^\n]*+"""
MARK, OTHER = "￿", "￾"
BLOCK = "struct<word:string,name:string,start:int,indent:int,depth:int,inside:string,end:int>"


def _blanked(code: Column) -> Column:
    """The code with `s` in place of each string and nothing in place of comments; line ends within strings and behind
    backslashes stand in brackets, so that no statement seems to begin after them."""
    marked = F.regexp_replace(F.translate(code, MARK, OTHER), LITERAL, f"{MARK}$0{MARK}")
    ends = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    long = lambda x: x.startswith('"' * 3) | x.startswith("'" * 3)
    many = lambda x: F.concat(F.lit("s("), F.repeat(F.lit("\n"), ends(x)), F.lit(")"))
    # A short string that isn't closed ends with its line.
    bare = lambda x: F.when(x.startswith("#"), "").when(ends(x) == 0, "s").when(long(x) | x.contains("\\\n"), many(x)).otherwise("s\n")
    plain = lambda x: F.regexp_replace(x, r"\\\r?\n", "(\n)")
    return F.array_join(F.transform(F.split(marked, MARK, -1), lambda x, i: F.when(i % 2 == 1, bare(x)).otherwise(plain(x))), "")


def statement_lines(files: DataFrame) -> DataFrame:
    """files with `starts`: for each line that begins a statement its number, indent, and stripped text without strings;
    `filled`: the numbers of the lines with anything but comments on them."""
    count = lambda line, marks: F.length(line) - F.length(F.translate(line, marks, ""))
    rows = files.withColumn("__lines", split_lines(_blanked(F.col("code"))))
    # How many brackets each line opens less those it closes; lines that follow an open one begin no statement.
    rows = rows.withColumn("__net", F.transform("__lines", lambda x: (count(x, "([{") - count(x, ")]}")).cast("int")))
    zero = F.struct(F.lit(0).alias("open"), F.lit(0).alias("i"), F.expr("cast(array() as array<int>)").alias("free"))

    def step(acc: Column, net: Column) -> Column:
        free = F.when(acc["open"] <= 0, F.concat(acc["free"], F.array(acc["i"]))).otherwise(acc["free"])
        return F.struct(F.greatest(F.lit(0), acc["open"] + net).alias("open"), (acc["i"] + 1).alias("i"), free.alias("free"))

    # Only files with a bracket that stays open over a line's end need the fold.
    every = F.sequence(F.lit(0), F.size("__lines") - 1)
    free = F.when(F.exists("__net", lambda n: n != 0), F.aggregate("__net", zero, step, lambda acc: acc["free"])).otherwise(every)
    each = F.transform(F.when(F.size("__lines") > 0, free), lambda i: F.struct((i + 1).alias("no"), indent(F.get("__lines", i)).cast("int").alias("indent"), strip(F.get("__lines", i)).alias("text")))
    filled = F.filter(F.transform("__lines", lambda x, i: F.when(strip(x) != "", i + 1)), lambda n: n.isNotNull())
    return rows.withColumns({"starts": F.filter(each, lambda s: s["text"] != ""), "filled": filled}).drop("__lines", "__net")


def python_blocks(files: DataFrame) -> DataFrame:
    """file_id, word, name, line_start, line_end, depth (1: outermost), inside (name of the function or class around) of each block."""
    rows = statement_lines(files.where((F.col("language") == "python") & F.col("code").isNotNull()).select("file_id", "code"))
    none = F.expr(f"cast(array() as array<{BLOCK}>)")
    start = F.struct(none.alias("open"), none.alias("done"), F.lit(0).alias("last"))

    def step(acc: Column, s: Column) -> Column:
        goes_on = s["text"].rlike(rf"^(?:{GOES_ON})\b")
        stays = lambda b: (b["indent"] < s["indent"]) | ((b["indent"] == s["indent"]) & goes_on & ~b["word"].isin("def", "class"))
        ended = F.transform(F.filter(acc["open"], lambda b: ~stays(b)), lambda b: b.withField("end", acc["last"]))
        kept = F.filter(acc["open"], stays)
        word = F.regexp_extract(s["text"], rf"^(?:async\s+)?({HEADS})\b", 1)
        name = F.regexp_extract(s["text"], r"^(?:async\s+)?(?:def|class)\s+(\w+)", 1)
        around = F.element_at(F.filter(F.concat(F.array(F.lit(None).cast("string")), F.transform(kept, lambda b: F.coalesce(b["name"], b["inside"]))), lambda n: F.lit(True)), -1)
        block = F.struct(
            word.alias("word"), F.when(name != "", name).alias("name"), s["no"].alias("start"), s["indent"].alias("indent"), (F.size(kept) + 1).alias("depth"), around.alias("inside"), F.lit(None).cast("int").alias("end")
        )
        return F.struct(F.concat(kept, F.when(word != "", F.array(block)).otherwise(none)).alias("open"), F.concat(acc["done"], ended).alias("done"), s["no"].alias("last"))

    found = F.aggregate("starts", start, step, lambda acc: F.concat(acc["done"], F.transform(acc["open"], lambda b: b.withField("end", F.lit(None).cast("int")))))
    rows = rows.select("file_id", "starts", "filled", F.explode(found).alias("b"))
    # `end` is where a block's last statement begins; it goes on to the last line before the next statement.
    after = F.array_min(F.transform(F.filter("starts", lambda s: s["no"] > F.col("b.end")), lambda s: s["no"]))
    last = F.array_max(F.filter("filled", lambda n: n < F.coalesce(after, F.lit(2**31 - 1))))
    return rows.select("file_id", "b.word", "b.name", F.col("b.start").alias("line_start"), last.alias("line_end"), "b.depth", "b.inside")


def block_metrics(blocks: DataFrame) -> DataFrame:
    """file_id, n_functions, n_classes, max_nesting, max_function_length, avg_function_length of files that have blocks."""
    length, is_def = F.col("line_end") - F.col("line_start") + 1, F.col("word") == "def"
    return blocks.groupBy("file_id").agg(
        F.count_if(is_def).alias("n_functions"), F.count_if(F.col("word") == "class").alias("n_classes"), F.max("depth").alias("max_nesting"),
        F.coalesce(F.max(F.when(is_def, length)), F.lit(0)).alias("max_function_length"), F.avg(F.when(is_def, length)).alias("avg_function_length"),
    )
