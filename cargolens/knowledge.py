"""Tables of names, words and limits that the rules compare with. All of them are fixed values."""

from __future__ import annotations

# --- pickle: module:attribute pairs by severity; exact pairs go before whole modules ---------------

CRITICAL_GLOBALS = [
    "os:system", "os:popen", "os:execv", "os:execve", "os:execl", "os:spawnl", "os:spawnv", "os:fork", "os:remove", "os:unlink", "os:rmdir",
    "os:chmod", "os:putenv", "posix:system", "nt:system", "subprocess:run", "subprocess:call", "subprocess:check_call", "subprocess:check_output",
    "subprocess:Popen", "subprocess:getoutput", "builtins:eval", "builtins:exec", "builtins:compile", "builtins:__import__", "builtins:getattr",
    "builtins:setattr", "builtins:open", "builtins:breakpoint", "builtins:input", "__builtin__:eval", "__builtin__:exec", "__builtin__:compile",
    "__builtin__:__import__", "__builtin__:open", "runpy:_run_code", "runpy:run_path", "runpy:run_module", "importlib:import_module",
    "importlib.machinery:SourceFileLoader", "pty:spawn", "pdb:run", "bdb:run", "timeit:timeit", "code:interact", "codeop:compile_command",
    "commands:getoutput", "popen2:popen2", "platform:popen", "venv:create", "sysconfig:_main",
]
HIGH_GLOBALS = [
    "socket:socket", "socket:create_connection", "urllib.request:urlopen", "urllib.request:urlretrieve", "urllib:urlopen", "requests:get",
    "requests:post", "http.client:HTTPSConnection", "ftplib:FTP", "smtplib:SMTP", "shutil:rmtree", "shutil:copy", "shutil:move", "ctypes:CDLL",
    "ctypes:WinDLL", "ctypes:cdll", "multiprocessing:Process", "threading:Thread", "webbrowser:open", "pickle:loads", "pickle:load", "_pickle:loads",
    "dill:loads", "torch:load", "torch.serialization:load", "torch.storage:_load_from_bytes", "pandas:read_pickle", "joblib:load", "numpy:load",
    "numpy.testing._private.utils:runstring", "numpy.testing:runstring", "sys:exit", "operator:attrgetter", "operator:methodcaller",
    "functools:partial", "functools:reduce", "types:FunctionType", "types:CodeType", "marshal:loads", "base64:b64decode", "zlib:decompress",
    "bz2:decompress", "lzma:decompress", "gzip:decompress", "tempfile:mktemp", "shlex:split", "getattr:getattr",
]
WATCH_GLOBALS = ["_codecs:encode", "codecs:encode", "codecs:decode"]
CRITICAL_MODULES = ["os", "posix", "nt", "subprocess", "sys", "socket", "shutil", "ctypes", "pty", "importlib", "runpy", "marshal", "pickle", "_pickle", "dill", "cloudpickle"]
HIGH_MODULES = ["requests", "urllib", "urllib.request", "http", "http.client", "ftplib", "smtplib", "telnetlib", "paramiko", "asyncio"]
ALLOWED_PREFIXES = [
    "torch._utils", "torch.nn", "torch.optim", "torch.storage", "torch.Tensor", "torch.FloatStorage", "torch.serialization", "collections",
    "numpy.core.multiarray", "numpy._core.multiarray", "numpy.core.numeric", "numpy._core.numeric", "numpy.dtype", "numpy.ndarray", "numpy.random",
    "numpy", "scipy.sparse", "sklearn", "pandas.core", "transformers", "tokenizers", "argparse", "fairseq", "omegaconf", "__builtin__.set",
]
ALLOWED_GLOBALS = [
    "torch:Tensor", "torch:device", "torch:Size", "torch:FloatStorage", "torch:HalfStorage", "torch:LongStorage", "torch:IntStorage",
    "torch:ByteStorage", "torch:BoolStorage", "torch:BFloat16Storage", "torch:DoubleStorage", "torch:ShortStorage", "torch:CharStorage",
    "torch:float32", "torch:float16", "torch:bfloat16", "torch:int64", "torch:int8", "torch:uint8", "collections:OrderedDict",
    "collections:defaultdict", "builtins:set", "builtins:frozenset", "builtins:dict", "builtins:list", "builtins:tuple", "builtins:int",
    "builtins:float", "builtins:str", "builtins:bytes", "builtins:complex", "builtins:bytearray", "builtins:object", "copyreg:_reconstructor",
    "numpy:dtype", "numpy:ndarray", "numpy:float32",
]
CALL_OPCODES = ["REDUCE", "INST", "OBJ", "NEWOBJ", "NEWOBJ_EX", "BUILD"]
STRING_OPCODES = ["SHORT_BINUNICODE", "BINUNICODE", "BINUNICODE8", "UNICODE", "SHORT_BINSTRING", "BINSTRING", "STRING", "BINBYTES", "SHORT_BINBYTES"]
SHELL_MARKERS = ["/bin/sh", "/bin/bash", "curl ", "wget ", "nc -", "powershell", "base64 -d", "chmod +x", "http://", "https://", "cmd.exe", "socket.socket", "os.system", "import os", "__import__"]
SHELL_MARKERS_HIGH = ["/bin/sh", "curl ", "wget ", "powershell", "cmd.exe"]
MAX_STRINGS = 200

# --- formats ---------------------------------------------------------------------------------------

#: (label, offset, bytes as hex); the first that fits names a file's magic.
MAGIC = [
    ("zip", 0, "504B0304"), ("zip-empty", 0, "504B0506"), ("hdf5", 0, "894844460D0A1A0A"), ("gguf", 0, "47475546"), ("npy", 0, "934E554D5059"),
    ("elf", 0, "7F454C46"), ("pe", 0, "4D5A"), ("macho64", 0, "CFFAEDFE"), ("macho32", 0, "CEFAEDFE"), ("macho-fat", 0, "CAFEBABE"),
    ("gzip", 0, "1F8B"), ("bzip2", 0, "425A68"), ("xz", 0, "FD377A585A00"), ("lz4", 0, "04224D18"), ("zstd", 0, "28B52FFD"),
    ("tar", 257, "757374617200"), ("tar", 257, "7573746172202000"), ("7z", 0, "377ABCAF271C"), ("rar", 0, "526172211A07"), ("script-shebang", 0, "2321"),
]
LFS_PREFIX = "version https://git-lfs.github.com/spec/"
PICKLE_EXTENSIONS = [".pkl", ".pickle", ".bin", ".pt", ".pth", ".ckpt", ".dat", ".joblib", ".dill", ".model", ".pb2", ".torch"]
CODE_EXTENSIONS = [".py", ".pyc", ".pyo", ".pyd", ".sh", ".bash", ".zsh", ".ps1", ".bat", ".cmd", ".pl", ".rb", ".js", ".mjs", ".vbs", ".jar", ".so", ".dll", ".dylib", ".exe", ".elf", ".bin_exec"]
TEXT_EXTENSIONS = [".md", ".txt", ".json", ".yaml", ".yml", ".toml", ".cfg", ".gitattributes", ".gitignore", ".csv", ".tsv", ".jsonl"]
#: First bytes of protocol 0 and 1 streams, which have no magic number.
OLD_PICKLE_HEADS = "(]}cS VIL\x88\x89NK"
EXPECTED_FORMATS = {".safetensors": ["safetensors"], ".gguf": ["gguf"], ".json": ["unknown", "text"], ".onnx": ["unknown"], ".h5": ["hdf5"], ".npz": ["zip"], ".txt": ["unknown", "text"], ".md": ["unknown", "text"]}
MEMBER_LIMIT = DECOMPRESSED_LIMIT = 64 << 20
RATIO_LIMIT = 200
ARCHIVE_CODE_EXTENSIONS = [".py", ".sh", ".exe", ".dll", ".so", ".dylib", ".bat", ".ps1"]
KERAS_MODULES = ["keras", "tensorflow", "tf", "tf_keras"]
DTYPE_BYTES = {"F64": 8, "I64": 8, "U64": 8, "F32": 4, "I32": 4, "U32": 4, "F16": 2, "BF16": 2, "I16": 2, "U16": 2, "I8": 1, "U8": 1, "BOOL": 1, "F8_E4M3": 1, "F8_E5M2": 1}
ONNX_OPS = ["PythonOp", "ATen", "Custom", "com.microsoft", "ai.onnx.contrib"]
TF_OPS = ["PyFunc", "PyFuncStateless", "ReadFile", "WriteFile", "MergeV2Checkpoints", "Save", "SaveV2", "ShardedFilename"]
HDF5_MARKERS = ["__reduce__", "os.system", "subprocess", "eval("]

# --- code and configuration ------------------------------------------------------------------------

CALL_SEVERITY = {"eval": "HIGH", "exec": "HIGH", "compile": "MEDIUM", "__import__": "HIGH", "system": "CRITICAL", "popen": "CRITICAL", "Popen": "HIGH", "run": "LOW", "check_output": "HIGH", "call": "LOW", "urlopen": "HIGH", "urlretrieve": "HIGH", "loads": "LOW", "load": "LOW", "b64decode": "MEDIUM", "CDLL": "HIGH", "spawn": "HIGH", "connect": "MEDIUM"}
IMPORT_SEVERITY = {"os": "MEDIUM", "subprocess": "HIGH", "socket": "HIGH", "ctypes": "HIGH", "pty": "CRITICAL", "telnetlib": "HIGH", "paramiko": "MEDIUM", "pickle": "MEDIUM", "marshal": "MEDIUM", "requests": "LOW", "urllib": "LOW", "shutil": "LOW", "base64": "LOW"}
TEMPLATE_FILES = ["tokenizer_config.json", "chat_template.json", "chat_template.jinja", "processor_config.json", "generation_config.json", "config.json"]
TEMPLATE_KEYS = ["chat_template", "chat_templates", "template", "default_chat_template", "prompt_template"]
TEMPLATE_HINT = r"__class__|__mro__|__subclasses__|__globals__|__builtins__|__init__|__import__|__reduce__|lipsum|cycler|joiner|namespace|self\.__|config\.items|request\.application|os\.popen|attr\s*\("
TEMPLATE_MARK = r"\{\{|\{%"
WEIGHT_ENDS_PICKLE = [".bin", ".pt", ".pth", ".ckpt", ".pkl"]
WEIGHT_ENDS = [".safetensors", ".bin", ".pt", ".pth", ".ckpt", ".gguf", ".onnx", ".h5", ".npz"]
INSTALL_FILES = ["setup.py", "requirements.txt", "pyproject.toml", "Dockerfile", "install.sh", "run.sh", "entrypoint.sh"]
SIGNATURE_ENDS = [".sig", ".sigstore", ".intoto.jsonl"]
UNLISTED_FILES = ["README.md", ".gitattributes", ".gitignore"]

# --- names -----------------------------------------------------------------------------------------

CONFUSABLES = [("rn", "m"), ("m", "rn"), ("vv", "w"), ("w", "vv"), ("1", "l"), ("l", "1"), ("l", "i"), ("i", "l"), ("1", "i"), ("0", "o"), ("o", "0"), ("5", "s"), ("s", "5"), ("cl", "d")]
SEED_ORGS = [
    "meta-llama", "google", "openai", "openai-community", "mistralai", "microsoft", "facebook", "huggingface", "hf-internal-testing", "bigscience",
    "stabilityai", "runwayml", "nvidia", "eleutherai", "tiiuae", "databricks", "cohereforai", "qwen", "deepseek-ai", "allenai",
    "sentence-transformers", "bigcode", "salesforce", "intel", "apple", "ibm-granite", "01-ai", "togethercomputer", "mosaicml", "anthropic", "amazon",
    "baai", "thudm", "laion", "timm", "openmmlab", "ultralytics", "kakaobrain", "naver-clova-ix", "xlm-roberta", "distilbert", "state-spaces",
    "nousresearch", "teknium", "unsloth", "bartowski", "thebloke", "lmsys", "vikhyatk", "black-forest-labs",
]
SEED_MODELS = [
    "llama-2-7b", "llama-2-13b", "llama-2-70b", "llama-3-8b", "llama-3-70b", "meta-llama-3-8b-instruct", "llama-3.1-8b-instruct", "llama-3.2-1b",
    "bert-base-uncased", "bert-large-uncased", "roberta-base", "gpt2", "gpt2-medium", "gpt2-large", "gpt2-xl", "t5-base", "t5-small", "flan-t5-base",
    "distilbert-base-uncased", "xlm-roberta-base", "clip-vit-base-patch32", "stable-diffusion-v1-5", "stable-diffusion-xl-base-1.0", "sdxl-turbo",
    "whisper-large-v3", "whisper-base", "wav2vec2-base-960h", "mistral-7b-instruct-v0.2", "mixtral-8x7b-instruct-v0.1", "phi-2",
    "phi-3-mini-4k-instruct", "gemma-7b-it", "gemma-2-9b-it", "qwen2-7b-instruct", "deepseek-coder-6.7b-instruct", "all-minilm-l6-v2",
    "all-mpnet-base-v2", "codellama-7b", "falcon-7b-instruct", "mpt-7b-instruct", "vicuna-7b-v1.5",
]
STALE_DAYS = 90

# --- scoring ---------------------------------------------------------------------------------------

SEVERITY_WEIGHT = {"CRITICAL": 55, "HIGH": 22, "MEDIUM": 8, "LOW": 2, "INFO": 0}
CONFIDENCE_FACTOR = {"high": 1.0, "medium": 0.7, "low": 0.4}
DECAY = 0.65
