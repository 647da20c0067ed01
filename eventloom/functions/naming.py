"""Names of classes, methods, frames and threads of the JVM, and paths into stack traces, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Descriptors of primitive types, and packages whose classes are not an application's.
PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}
SYSTEM_PACKAGES = ("java.", "javax.", "jdk.", "sun.", "com.sun.")
CONSTRUCTORS = ("<init>", "<clinit>")


def _type_name(descriptor: Column) -> Column:
    """`[[I` as int[][], `Ljava/lang/String;` as java.lang.String; what is no descriptor stays, with dots."""
    depth = F.length(F.regexp_extract(descriptor, r"^\[*", 0))
    base = F.regexp_replace(F.regexp_replace(descriptor, r"^\[+", ""), r"^L(.*);$", "$1")
    kind = base
    for short, name in PRIMITIVES.items():
        kind = F.when(base == short, name).otherwise(kind)
    return F.concat(F.translate(kind, "/", "."), F.repeat(F.lit("[]"), depth))


def class_name(name: Column) -> Column:
    """The readable form of a class name: arrays as `int[]`, slashes as dots."""
    return F.when(name.startswith("["), _type_name(name)).otherwise(F.translate(name, "/", "."))


def parameters(descriptor: Column) -> Column:
    """`(IJLjava/lang/String;)V` as `int, long, String`."""
    inside = F.regexp_extract(descriptor, r"\(([^)]*)\)", 1)
    each = F.regexp_extract_all(inside, F.lit(r"(\[*(?:L[^;]*;|[BCDFIJSZ]))"), 1)
    return F.array_join(F.transform(each, lambda d: F.substring_index(_type_name(d), ".", -1)), ", ")


def method(m: Column) -> Column:
    """Class, name and parameters of a method struct (type.name, name, descriptor)."""
    return F.concat(class_name(m["type"]["name"]), F.lit("."), m["name"], F.lit("("), F.coalesce(parameters(m["descriptor"]), F.lit("")), F.lit(")"))


def thread(t: Column) -> Column:
    """The Java name, or else the name that the system knows."""
    return F.coalesce(F.nullif(t["javaName"], F.lit("")), t["osName"])


def has(kind: T.DataType, path: str) -> bool:
    """Whether a struct type has a dotted path."""
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return False
        kind = kind[part].dataType
    return True


def display(x: Column, kind: T.DataType) -> Column:
    """The text that a struct is shown as, by its fields: threads, stack traces (their first frame), frames, methods, classes, loaders.

    Class loaders show the name of their class, other structs their name or else JSON. Other columns are cast to text.
    """
    if not isinstance(kind, T.StructType):
        return x.cast("string")
    if "javaName" in kind.names or "osName" in kind.names:
        names = [F.nullif(x[n], F.lit("")) for n in ("javaName", "osName") if n in kind.names]
        return F.coalesce(*names)
    if "frames" in kind.names and isinstance(kind["frames"].dataType, T.ArrayType):
        return display(top_frame(x["frames"]), kind["frames"].dataType.elementType)
    if has(kind, "method.type.name") or has(kind, "method.name"):
        return display(x["method"], kind["method"].dataType)
    if has(kind, "type.name") and "descriptor" in kind.names:
        return method(x)
    if is_loader(kind):
        return class_name(x["type"]["name"])
    if "name" in kind.names:
        return class_name(x["name"]) if {"package", "modifiers", "classLoader"} & set(kind.names) else x["name"].cast("string")
    return F.to_json(x)


def is_loader(kind: T.DataType) -> bool:
    return has(kind, "type.name") and "descriptor" not in kind.names and "method" not in kind.names


def identity(x: Column, kind: T.DataType) -> Column:
    """What a struct is grouped by: threads and class loaders by all fields, others by how they are shown; other columns by themselves."""
    if not isinstance(kind, T.StructType) or "javaName" in kind.names or "osName" in kind.names or is_loader(kind):
        return x
    return display(x, kind)


def is_system_class(name: Column) -> Column:
    dotted = F.translate(name, "/", ".")
    found = F.lit(False)
    for package in SYSTEM_PACKAGES:
        found = found | dotted.startswith(package)
    return found


def top_frame(frames: Column) -> Column:
    """The first frame; null if there is none."""
    return F.try_element_at(frames, F.lit(1))


def top_ordinary_frame(frames: Column) -> Column:
    """The first frame that is no constructor or class initialiser, else the first."""
    ordinary = F.filter(frames, lambda f: ~F.coalesce(f["method"]["name"].isin(*CONSTRUCTORS), F.lit(False)))
    return F.coalesce(F.try_element_at(ordinary, F.lit(1)), top_frame(frames))


def top_application_frame(frames: Column) -> Column:
    """The first frame of a class outside the system packages; null if there is none."""
    return F.try_element_at(F.filter(frames, lambda f: ~is_system_class(f["method"]["type"]["name"])), F.lit(1))


def short_class(name: Column) -> Column:
    """The last part of a name with two dots or more, as narrow columns show it."""
    parts = F.size(F.split(name, r"\."))
    return F.when((parts >= 3) & name.rlike(r"^[\w$]+(\.[\w$]+)+(\[\])*$"), F.substring_index(name, ".", -1)).otherwise(name)


def short_method(text: Column) -> Column:
    """A method without its parameter list."""
    return F.regexp_replace(text, r"\([^)]+\)", "(...)")
