"""A code corpus derived from the table documents: our own templates, each followed by a document's whole text.

The driver's tables hold no source code, so rules run over this relation; it is spelled the same in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.predicates import quote
from lintlake.sources.files import spread

TEMPLATES: list[tuple[str, str]] = [
    ("python", '''import os, pickle, random, requests, yaml, hashlib
def load(path, seen=[]):
    try:
        return pickle.loads(open(path).read())
    except:
        pass
def token_for(user):
    token = random.randint(1000, 9999)
    print("token", token)
    return eval("user" + str(token))
api_key = "abcd1234efgh5678"
def run(cmd, cursor, name):
    os.system("ls " + cmd)
    cursor.execute("SELECT * FROM t WHERE n = '%s'" % name)
    url = request.args.get("u")
    requests.get(url)
    digest = hashlib.md5(name)
    config = yaml.load(name, Loader=yaml.SafeLoader)
    # TODO: 777 is checked by hand
    size(7777)
    token_for(name)
'''),
    ("python", '''import re, subprocess
from xml.dom import minidom
def scan(names: list) -> list:
    out = ""
    for n in names:
        if re.compile(n).match("a"):
            out += "x"
        data = minidom.parse(n)
    subprocess.run(
        "grep " + out,
        shell=True)
    yaml.load(out)
    q = request.form["q"]
    sink = q + "1"
    cursor.execute(sink)
    path = sys.argv[1]
    handle = open(path)
    return out
'''),
    ("python", '''"""Nothing wrong here."""
from defusedxml import minidom
# eval(x) in a comment
def area(width: float, height: float) -> float:
    """Area of a box."""
    return width * height
class Box:
    def __init__(self, width: float) -> None:
        self.width = width
'''),
    ("javascript", '''var total = 0;
console.log("start");
el.innerHTML = data;
const t = jwt.decode(token);
for (const k of keys) {
  const r = new RegExp(k);
  target[k] = source[k];
}
async function go() {
  return fetch(url);
}
const secret = "s3cr3tvalue";
const body = req.body;
db.query(body);
// FIXME: later
fs.readFile(req.query.name);
'''),
    ("javascript", '''const ok = jwt.verify(t, key, { algorithms: ["RS256"] });
if (k === "__proto__") { skip(); }
target[k] = source[k];
const f = async () => { await step(); };
// var hidden = 1
let limit = 12345;
'''),
    ("typescript", '''let a: any = load();
const b = c!.name;
const d = e![0];
const g = h!;
if (!ready) { stop(); }
jwt.verify(token, key);
const v = x as any;
console.debug(v);
const password = "longpassword";
'''),
    ("go", '''package store
func Save(name string, ctx context.Context) error {
	f, _ := os.Open(name)
	mu.Lock()
	x = 1
	y = 2
	z = 3
	go func() { work() }()
	q := fmt.Sprintf("SELECT * FROM t WHERE n = '%s'", name)
	panic("no")
	host := "10.1.2.3"
	return db.Query(q)
}
'''),
    ("go", '''package main
func main() {
	ch := make(chan int)
	ch <- 1
	mu.Lock()
	defer mu.Unlock()
	local := "127.0.0.1"
	panic("fine here")
	fmt.Println("password", local)
}
'''),
    ("java", '''import java.util.List;
class A {
  void run(String name) {
    List items = load();
    FileReader r = new FileReader(name);
    try {
      String q = "SELECT * FROM t WHERE n = " + name;
      String s = map.get(name).trim();
    } catch (Exception e) {
      System.out.println("failed");
    }
    for (String w : words) {
      out += "x";
    }
    MessageDigest m = MessageDigest.getInstance("MD5");
  }
}
'''),
    ("java", '''class B {
  void run(Path p) throws IOException {
    try (BufferedReader r = new BufferedReader(open(p))) {
      log.info("read");
    } catch (IOException e) {
      throw e;
    }
  }
}
'''),
    ("rust", '''fn main() {
    let a = load().unwrap();
    let b = a.clone();
    let c = b.clone();
    let d = c.clone();
    let e = d.clone();
    let f = e.clone();
    unsafe { touch(f) }
    let g = open().expect("no");
    todo!()
}
#[cfg(test)]
mod tests {
    fn t() { x.unwrap(); }
}
fn after() { y.unwrap(); }
'''),
    ("rust", '''// unsafe { in a comment }
fn add(a: i32, b: i32) -> i32 {
    a + b
}
'''),
]


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, language, code: each document's text after the template that its id picks."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id", "text")
    return docs.select(F.col("doc_id").alias("file_id"), _picked(0).alias("language"), F.concat(_picked(1), "text").alias("code"))


def _picked(part: int) -> Column:
    """Language (0) or code (1) of the template that a document's id picks."""
    return F.get(F.array(*(F.lit(t[part]) for t in TEMPLATES)), F.pmod("doc_id", F.lit(len(TEMPLATES))).cast("int"))


def code_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, language of the files of code_files, without reading or moving a text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return docs.select(F.col("doc_id").alias("file_id"), _picked(0).alias("language"))


def code_files_sql() -> str:
    rows = ", ".join(f"({i}, {quote(language)}, {quote(code)})" for i, (language, code) in enumerate(TEMPLATES))
    return f"select doc_id as file_id, t.language, t.code || text as code from documents join (values {rows}) as t(k, language, code) on doc_id % {len(TEMPLATES)} = t.k"


def shaped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, language, code: for each document a Python function whose depth of nesting and length follow from the id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    deep, long = F.pmod("doc_id", F.lit(13)).cast("int"), (F.pmod("doc_id", F.lit(130)) + 1).cast("int")
    ifs = F.transform(F.sequence(F.lit(1), F.lit(13)), lambda k: F.when(k <= deep, F.concat(F.repeat(F.lit("    "), k), F.lit("if a:\n"))).otherwise(""))
    body = F.repeat(F.concat(F.repeat(F.lit("    "), deep + 1), F.lit("a = a + 1\n")), long)
    code = F.concat(F.lit("def grow(a):\n"), F.array_join(ifs, ""), body)
    return docs.select(F.col("doc_id").alias("file_id"), F.lit("python").alias("language"), code.alias("code"))


def noted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of shaped_files, those of even ids with two comments before each statement of the body."""
    line = r"( *)a = a \+ 1\n"
    noted = F.regexp_replace("code", line, "$1# one more\n$1# step\n$0")
    return shaped_files(spark, sf_dir).withColumn("code", F.when(F.col("file_id") % 2 == 0, noted).otherwise(F.col("code")))


def shaped_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, language, code: the same for JavaScript, with braces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    deep, long = F.pmod("doc_id", F.lit(13)).cast("int"), (F.pmod("doc_id", F.lit(130)) + 1).cast("int")
    code = F.concat(F.lit("function grow(a) {\n"), F.repeat(F.lit("if (a) {\n"), deep), F.repeat(F.lit("a = a + 1;\n"), long), F.repeat(F.lit("}\n"), deep + 1))
    return docs.select(F.col("doc_id").alias("file_id"), F.lit("javascript").alias("language"), code.alias("code"))


def repeated_files(spark: SparkSession, sf_dir: str, times: int = 30) -> DataFrame:
    """The files of code_files, each written out `times` times over."""
    return code_files(spark, sf_dir).withColumn("code", F.repeat(F.concat("code", F.lit("\n")), F.lit(times)))


def repeated_files_sql(times: int = 30) -> str:
    return f"select file_id, language, repeat(code || chr(10), {times}) as code from ({code_files_sql()})"
