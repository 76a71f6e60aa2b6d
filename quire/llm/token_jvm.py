"""The token coder as two functions of the JVM, which take and give whole frames.

``TokenCoder.java`` is compiled when a session first asks for it, by the compiler that Spark has for its own generated code, and goes to the
executors as a jar. What it writes ``token_files.decode_frame`` reads without a JVM, and the other way round.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from importlib import resources

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_ENCODE, _DECODE = "quire_encode_frame", "quire_decode_frame"
_jars: dict[str, str] = {}


def _jar(spark: SparkSession) -> str:
    """The jar's path on the driver, added to the application."""
    key = spark.sparkContext.applicationId
    if key not in _jars:
        jvm = spark._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(spark._jsparkSession.getClass().getClassLoader())
        compiler.cook(resources.files(__package__).joinpath("TokenCoder.java").read_text(encoding="utf-8"))
        handle, path = tempfile.mkstemp(prefix="quire-token-coder-", suffix=".jar")
        with os.fdopen(handle, "wb") as f, zipfile.ZipFile(f, "w") as jar:
            for name, code in dict(compiler.getBytecodes()).items():
                jar.writestr(name.replace(".", "/") + ".class", bytes(code))
        atexit.register(lambda: os.path.exists(path) and os.remove(path))
        spark.sql(f"ADD JAR '{path}'")
        _jars[key] = path
    return _jars[key]


def _register(spark: SparkSession, tables: tuple[np.ndarray, np.ndarray]) -> None:
    _jar(spark)
    jvm, session = spark._jvm, spark._jsparkSession
    given = bytearray(b"".join(t.astype("<i4").tobytes() for t in tables))
    kind = jvm.org.apache.spark.sql.types.DataType.fromDDL("binary")
    for name, inner in ((_ENCODE, "Encode"), (_DECODE, "Decode")):
        made = jvm.java.lang.Class.forName(f"quire.TokenCoder${inner}", True, session.sharedState().jarClassLoader())
        function = made.getDeclaredConstructor(spark.sparkContext._gateway.new_array(jvm.java.lang.Class, 0)).newInstance(spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 0))
        function.take(given, len(tables[0]))
        session.udf().register(name, function, kind)


def encoded(spark: SparkSession, frame: Column, tables: tuple[np.ndarray, np.ndarray]) -> Column:
    """The coded frame of a plain one. ``tables``: squashed and stretched predictions."""
    _register(spark, tables)
    return F.call_function(_ENCODE, frame)


def decoded(spark: SparkSession, frame: Column, n: Column, tables: tuple[np.ndarray, np.ndarray]) -> Column:
    """The plain frame of a coded one with ``n`` tokens."""
    _register(spark, tables)
    return F.call_function(_DECODE, frame, n)
