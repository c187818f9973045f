"""Java classes of this subpackage, compiled by the Janino that Spark brings and given to executors as a jar."""

from __future__ import annotations

import atexit
import os
import pkgutil
import shutil
import tempfile
import zipfile

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession

_loaders: dict[tuple[str, str], JavaObject] = {}


def instance(spark: SparkSession, name: str) -> JavaObject:
    """A new object of the class ``strataq.<name>``, whose source lies beside this file."""
    context = spark.sparkContext
    key = context.applicationId, name
    if key not in _loaders:
        compiler = context._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(spark._jsparkSession.getClass().getClassLoader())
        compiler.cook(pkgutil.get_data(__package__, f"{name}.java").decode())
        classes = compiler.getBytecodes()
        folder = tempfile.mkdtemp(prefix="strataq-")
        atexit.register(shutil.rmtree, folder, True)  # executors may ask for the jar at any time
        path = os.path.join(folder, f"strataq-{name}.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for entry in classes.entrySet():
                jar.writestr(entry.getKey().replace(".", "/") + ".class", bytes(entry.getValue()))
        context._jsc.addJar(path)
        _loaders[key] = compiler.getClassLoader()
    return _loaders[key].loadClass(f"strataq.{name}").newInstance()
