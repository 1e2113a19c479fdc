"""The catalogue of rules: what each one says, and what to do about it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: rule | what it found. Every rule that an operator can emit is here.
TITLES = {
    "FMT-001": "File is a pickle, which runs code when it is loaded",
    "PKL-001": "Pickle imports a dangerous name",
    "PKL-002": "Pickle imports a name that no framework needs",
    "PKL-003": "Pickle reaches objects through the extension registry",
    "PKL-004": "Pickle stream is damaged or cut off",
    "PKL-005": "Pickle holds strings like commands or addresses",
    "PKL-006": "Bytes follow the end of the pickle stream",
    "ZIP-000": "Archive can't be opened",
    "ZIP-001": "Archive member leaves the folder it is unpacked to",
    "ZIP-002": "Archive member is a symbolic link",
    "ZIP-003": "Compression ratio of a bomb",
    "ZIP-004": "Member is too large to read",
    "ZIP-005": "Member can't be read",
    "ZIP-006": "Archive holds a script or program",
    "ZIP-007": "Archive holds source that is compiled on load",
    "ENG-001": "Compressed data is beyond the size limit",
    "ENG-002": "Data can't be decompressed",
    "ENG-003": "Compression isn't supported",
    "ENG-004": "Compressed data has no known model format inside",
    "KRS-001": "Keras config has a Lambda layer",
    "KRS-002": "Keras config resolves to builtins",
    "KRS-003": "Keras config loads a class from a foreign module",
    "STF-000": "safetensors file is cut off",
    "STF-001": "safetensors header is longer than the file",
    "STF-002": "safetensors header is abnormally large",
    "STF-003": "safetensors header isn't JSON",
    "STF-004": "Tensor offsets are invalid",
    "STF-005": "Tensor ends behind the file's end",
    "STF-006": "Tensors overlap",
    "STF-007": "Metadata holds very long texts",
    "STF-008": "Tensor's shape and span differ",
    "NPY-000": "Array header can't be read",
    "NPY-001": "Array of objects: a pickle inside",
    "H5-001": "HDF5 model has a Lambda layer",
    "H5-002": "HDF5 file holds a suspicious literal",
    "ONX-001": "Graph uses foreign operators",
    "ONX-002": "Graph may read data outside its folder",
    "TF-001": "Graph can touch files or call back",
    "GGUF-001": "GGUF weights: data alone",
    "GGUF-002": "GGUF version is unknown",
    "LFS-001": "A pointer stands in for the file",
    "FILE-001": "File type doesn't belong among weights",
    "FILE-002": "Content and extension differ",
    "PY-000": "Python file doesn't parse",
    "PY-001": "Code imports a risky module",
    "PY-002": "Code makes a risky call",
    "PY-003": "Code acts when it is imported",
    "PY-004": "Code holds a very long string",
    "NB-001": "Notebook calls the shell or processes",
    "CFG-000": "config.json isn't JSON",
    "CFG-001": "Config asks for code of the repository",
    "CFG-002": "Config names a custom pipeline",
    "CFG-003": "Config field holds an address",
    "TPL-001": "Template reaches into Python",
    "TPL-002": "Template present",
    "TPL-003": "Template file isn't JSON",
    "REPO-001": "Weights are pickles alone",
    "REPO-002": "Pickled weights lie beside safe ones",
    "REPO-003": "Code that no config refers to",
    "REPO-004": "No README",
    "REPO-005": "Install script among weights",
    "REPO-006": "Remote repository holds code",
    "REPO-007": "Shard of an index is missing",
    "SIG-001": "Signatures present, not verified",
    "SIG-002": "Weights are unsigned",
    "SQT-001": "Identifier has non-ASCII characters",
    "SQT-002": "Organisation is an edit or two from a known one",
    "SQT-003": "Organisation looks like a known one",
    "SQT-004": "Organisation contains a known one",
    "SQT-005": "Known model under an unknown organisation",
    "SQT-006": "Model is one edit from a known one",
    "SQT-007": "Odd hyphens in the organisation",
    "SQT-008": "Organisation differs from a known one by case or separators",
    "SQT-009": "Corpus of names is old",
    "PRV-001": "Repository is very new",
    "PRV-002": "Repository is hardly used",
    "PRV-003": "Repository is gated",
    "PRV-004": "Repository is disabled",
    "PRV-005": "Repository is tagged as custom code",
    "PRV-006": "New publisher of many repositories",
    "PRV-007": "Local file that the repository doesn't list",
}
#: Rules beyond the common set; an audit emits them on request.
EXTENSIONS = ("PKL-006", "REPO-007")


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, t, r in EXTENSIONS) for r, t in TITLES.items()], "rule_id string, title string, extension boolean")
