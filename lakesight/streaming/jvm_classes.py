"""Java sources of this package as classes of a running application, for work where each call into Python is too dear."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from importlib.resources import files

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession

#: Class loaders of the driver by application and name.
_loaders: dict[tuple[str, str], JavaObject] = {}
_compiling = threading.Lock()


def jvm_class(spark: SparkSession, name: str) -> JavaObject:
    """The class ``lakesight.streaming.<name>``, compiled by the compiler that Spark has for generated code.

    Executors get it as a jar, which the driver serves as long as it lives.
    """
    key = (spark.sparkContext.applicationId, name)
    with _compiling:
        if key not in _loaders:
            _loaders[key] = _compiled(spark, name)
    return _loaders[key].loadClass(f"lakesight.streaming.{name}")


def _compiled(spark: SparkSession, name: str) -> JavaObject:
    java = spark._jvm.java
    compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook(files(__package__).joinpath(f"{name}.java").read_text())
    folder = tempfile.mkdtemp(prefix="lakesight-")
    # An application takes a file name once.
    jar = f"{folder}/{name}-{uuid.uuid4().hex}.jar"
    with zipfile.ZipFile(jar, "w") as classes:
        for found, code in compiler.getBytecodes().items():
            classes.writestr(f"{found.replace('.', '/')}.class", bytes(code))
    for path in (folder, jar):  # the JVM removes the last named first
        java.io.File(path).deleteOnExit()
    spark.sparkContext._jsc.addJar(jar)
    return compiler.getClassLoader()
