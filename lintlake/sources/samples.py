"""Labelled samples of code for benchmarks: clean ones by language, and vulnerable ones by weakness.

They are our own: clean samples are written from one form a language under many names, vulnerable ones one for each
weakness.  The last two need more than a line's pattern to be found, and the line rules are known to miss them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Names that the clean samples are written with: how many there are of a language is how many samples it has.
_WORDS = "area price level total width height offset margin weight volume depth speed angle ratio factor amount share index rank scale".split()
_CLEAN = {
    "python": ("def {0}_of(base: float, step: float) -> float:\n    \"\"\"The {0} of a step.\"\"\"\n    return base * step\n", 20),
    "javascript": ("function {0}Of(base, step) {{\n  const {0} = base * step;\n  return {0};\n}}\nmodule.exports = {{ {0}Of }};\n", 15),
    "typescript": ("export function {0}Of(base: number, step: number): number {{\n  const {0} = base * step;\n  return {0};\n}}\n", 10),
    "go": ("package shapes\n\nfunc {0}Of(base float64, step float64) float64 {{\n\treturn base * step\n}}\n", 8),
    "rust": ("pub fn {0}_of(base: f64, step: f64) -> f64 {{\n    base * step\n}}\n", 4),
    "java": ("final class {0}Rule {{\n  double of(double base, double step) {{\n    return base * step;\n  }}\n}}\n", 3),
}
_VULNERABLE = [
    ("eval", "python", "def run(text: str) -> object:\n    return eval(text)\n"),
    ("command", "python", "import os\n\ndef show(name: str) -> None:\n    os.system(\"ls \" + name)\n"),
    ("shell", "python", "import subprocess\n\ndef find(word: str) -> None:\n    subprocess.run(\"grep \" + word, shell=True)\n"),
    ("sql", "python", "def user(cursor: object, name: str) -> None:\n    cursor.execute(\"SELECT * FROM users WHERE name = '%s'\" % name)\n"),
    ("secret", "python", "api_key = \"k3y-of-the-house-0815\"\n"),
    ("weak-hash", "python", "import hashlib\n\ndef digest(data: bytes) -> object:\n    return hashlib.md5(data)\n"),
    ("yaml", "python", "import yaml\n\ndef settings(text: str) -> dict:\n    return yaml.load(text)\n"),
    ("html", "javascript", "function show(el, data) {\n  el.innerHTML = data;\n}\n"),
    ("log", "javascript", "function enter(user, password) {\n  console.log(password);\n}\n"),
    ("password", "typescript", "const password = \"open-the-gate-now\";\n"),
    ("sql-go", "go", "package store\n\nfunc user(name string) string {\n\treturn fmt.Sprintf(\"SELECT * FROM users WHERE name = '%s'\", name)\n}\n"),
    ("sql-java", "java", "class Users {\n  String query(String name) {\n    return \"SELECT * FROM users WHERE name = \" + name;\n  }\n}\n"),
    ("path", "python", "def page(folder: Path, name: str) -> str:\n    return (folder / name).read_text()\n"),
    ("request", "python", "def fetch(client: Client, place: str) -> str:\n    return client.get(place).text\n"),
]


def rows() -> list[tuple[int, str, str, str, str, str]]:
    """(file_id, sample_id, dataset, language, code, label) of all samples."""
    out = [(f"{lang}-{w}", "clean", lang, form.format(w), "clean") for lang, (form, n) in _CLEAN.items() for w in _WORDS[:n]]
    out += [(name, "weaknesses", lang, code, "vulnerable") for name, lang, code in _VULNERABLE]
    return [(i, *r) for i, r in enumerate(out)]


def samples(spark: SparkSession, datasets: tuple[str, ...] = ("clean", "weaknesses")) -> DataFrame:
    """file_id, sample_id, dataset, language, code, label: the union of the named datasets."""
    return spark.createDataFrame([r for r in rows() if r[2] in datasets], "file_id bigint, sample_id string, dataset string, language string, code string, label string")
