"""Language of a path: a left join to a small dimension of file names and extensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revtally.functions.text import ascii_lower

# Languages by lower-case file extension.
EXTENSIONS = {
    "ABAP": "abap",
    "ActionScript": "as",
    "Ada": "ada adb ads",
    "Agda": "agda",
    "Alloy": "als",
    "APL": "apl aplf apls",
    "Arduino C++": "ino",
    "AsciiDoc": "adoc asciidoc",
    "ASN.1": "asn1",
    "ASP": "asa asp",
    "ASP.NET": "asax ascx asmx aspx master sitemap webinfo",
    "Assembly": "asm",
    "Astro": "astro",
    "ATS": "dats hats sats atxt",
    "Autoconf": "in",
    "AutoHotKey": "ahk",
    "Automake": "am",
    "AWK": "awk",
    "Ballerina": "bal",
    "BASH": "bash",
    "Batch": "bat btm cmd",
    "Bazel": "bzl bazel bzlmod",
    "Bicep": "bicep bicepparam",
    "BitBake": "bb bbclass bbappend inc",
    "BrightScript": "brs",
    "C": "c ec pgc",
    "C Header": "h",
    "C Shell": "csh",
    "C#": "cs csx",
    "C++": "cc cpp cxx c++ pcc tpp",
    "C++ Header": "hh hpp hxx inl ipp",
    "Cabal": "cabal",
    "Cap'n Proto": "capnp",
    "Ceylon": "ceylon",
    "Clojure": "clj",
    "ClojureScript": "cljs",
    "CMake": "cmake",
    "COBOL": "cob cbl ccp cobol cpy",
    "CoffeeScript": "coffee cjsx",
    "ColdFusion": "cfm",
    "ColdFusion CFScript": "cfc",
    "Common Lisp": "lisp lsp asd",
    "Crystal": "cr",
    "CSS": "css",
    "CUDA": "cu",
    "CUE": "cue",
    "Cython": "pyx pxd pxi",
    "D": "d",
    "DAML": "daml",
    "Dart": "dart",
    "Device Tree": "dts dtsi",
    "Dhall": "dhall",
    "Dockerfile": "dockerfile dockerignore",
    "Edn": "edn",
    "Elixir": "ex exs",
    "Elm": "elm",
    "Emacs Lisp": "el",
    "Erlang": "erl hrl",
    "F#": "fs fsi fsx fsscript",
    "Factor": "factor",
    "Fennel": "fnl fnlm",
    "Fish": "fish",
    "Forth": "4th forth frt fth f83 fb fpm e4 rx ft",
    "FORTRAN Legacy": "f for ftn f77 pfo",
    "FORTRAN Modern": "f03 f08 f90 f95 fpp",
    "FreeMarker": "ftl ftlh ftlx",
    "GDScript": "gd",
    "Gherkin (Cucumber)": "feature",
    "Gleam": "gleam",
    "GLSL": "vert tesc tese geom frag comp glsl",
    "Go": "go",
    "Gradle": "gradle",
    "GraphQL": "gql graphql",
    "Groovy": "groovy grt gtpl gvy",
    "Haml": "haml",
    "Handlebars": "hbs handlebars",
    "Haskell": "hs",
    "Haxe": "hx",
    "HCL": "hcl tf tfvars",
    "HLSL": "hlsl",
    "HTML": "html htm",
    "Idris": "idr lidr",
    "INI": "ini",
    "Janet": "janet",
    "Java": "java",
    "JavaScript": "cjs js mjs",
    "Jinja2": "j2 jinja",
    "JSON": "json",
    "Jsonnet": "jsonnet libsonnet",
    "JSX": "jsx",
    "Julia": "jl",
    "Jupyter Notebooks": "ipynb",
    "Kotlin": "kt kts",
    "Lean": "lean hlean",
    "LESS": "less",
    "LLVM": "ll",
    "Lua": "lua luau",
    "M4": "m4",
    "Makefile": "makefile mak mk",
    "Mako": "mako mao",
    "Markdown": "md markdown",
    "MDX": "mdx",
    "Meson": "build",
    "MoonScript": "moon",
    "MSBuild": "csproj vbproj fsproj props targets",
    "Mustache": "mustache",
    "Nextflow": "nextflow nf",
    "Nim": "nim",
    "Nix": "nix",
    "Nushell": "nu",
    "Objective-C": "m",
    "Objective-C++": "mm",
    "OCaml": "ml mli re rei",
    "Odin": "odin",
    "OpenSCAD": "scad",
    "Org": "org",
    "Pascal": "pas",
    "Perl": "pl pm",
    "PHP": "php",
    "Plain Text": "text txt",
    "Pony": "pony",
    "PostCSS": "pcss sss",
    "PowerShell": "ps1 psm1 psd1 ps1xml cdxml pssc psc1",
    "Prolog": "p pro",
    "Protocol Buffers": "proto",
    "Pug": "pug",
    "Puppet": "pp",
    "PureScript": "purs",
    "Python": "py pyw pyi",
    "QML": "qml",
    "R": "r",
    "Racket": "rkt scrbl",
    "Rakefile": "rake",
    "Razor": "cshtml razor",
    "ReScript": "res resi",
    "ReStructuredText": "rst",
    "RON": "ron",
    "Ruby": "rb",
    "Rust": "rs",
    "Sass": "sass scss",
    "Scala": "sc scala",
    "Scheme": "scm ss",
    "Shell": "sh",
    "Slint": "slint",
    "Smalltalk": "st",
    "Snakemake": "smk rules",
    "Solidity": "sol",
    "SQL": "sql",
    "Stan": "stan",
    "Standard ML (SML)": "sml",
    "Stylus": "styl",
    "Svelte": "svelte",
    "SVG": "svg",
    "Swift": "swift",
    "SystemVerilog": "sv svh",
    "TCL": "tcl",
    "Templ": "templ",
    "Tera": "tera",
    "TeX": "tex sty",
    "Thrift": "thrift",
    "TOML": "toml",
    "TSX": "tsx",
    "Twig": "twig",
    "TypeScript": "ts mts cts",
    "Typst": "typ",
    "Vala": "vala",
    "VBScript": "vbs",
    "Velocity": "vm",
    "Verilog": "vg vh v",
    "VHDL": "vhd vhdl",
    "Vim Script": "vim",
    "Visual Basic": "vb",
    "Visual Studio Solution": "sln",
    "Vue": "vue",
    "WebAssembly": "wat wast",
    "WebGPU Shading Language": "wgsl",
    "Wolfram": "nb wl",
    "XAML": "xaml",
    "XML": "xml",
    "XSL": "xsl xslt",
    "YAML": "yaml yml",
    "Zig": "zig",
    "Zsh": "zsh",
}

# Languages by lower-case file name.
FILE_NAMES = {
    "CMake": "cmakelists.txt",
    "Dockerfile": "dockerfile .dockerignore",
    "Makefile": "makefile gnumakefile",
    "Meson": "meson.build meson_options.txt",
    "Rakefile": "rakefile",
    "SCons": "sconstruct sconscript",
    "BASH": ".bashrc .bash_profile",
}

DIMENSION = "kind STRING, key STRING, language STRING"


def language_dim(spark: SparkSession) -> DataFrame:
    """The built-in dimension ``(kind, key, language)``; ``kind`` is ``name`` or ``ext``."""
    rows = [
        (kind, key, language)
        for kind, table in (("name", FILE_NAMES), ("ext", EXTENSIONS))
        for language, keys in table.items()
        for key in keys.split()
    ]
    return spark.createDataFrame(rows, DIMENSION)


def file_name(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1))


def extension(path: Column) -> Column:
    """Text after the last dot of the file name; a leading dot alone starts no extension."""
    name = file_name(path)
    dotted = F.instr(F.substr(name, F.lit(2)), ".") > 0
    return F.when(dotted, F.nullif(F.substring_index(name, ".", -1), F.lit("")))


def with_language(changes: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """Set ``language`` from ``path``; NULL when neither the file name nor the extension is known.

    The built-in dimension is a few kilobytes and is broadcast. One given by the caller is
    left to Spark, which broadcasts it only when its size allows.
    """
    known = F.broadcast(language_dim(changes.sparkSession)) if dim is None else dim
    names = known.filter("kind = 'name'").select(F.col("key").alias("_name"), F.col("language").alias("_by_name"))
    exts = known.filter("kind = 'ext'").select(F.col("key").alias("_ext"), F.col("language").alias("_by_ext"))
    rest = [c for c in changes.columns if c != "language"]
    keyed = changes.select(*rest, file_name(F.col("path")).alias("_name"), extension(F.col("path")).alias("_ext"))
    joined = keyed.join(names, "_name", "left").join(exts, "_ext", "left")
    out = changes.columns if "language" in changes.columns else [*rest, "language"]
    return joined.withColumn("language", F.coalesce("_by_name", "_by_ext")).select(*out)


# Colours of languages and the colour of all others.
COLORS = {
    "Rust": "#dea584",
    "Go": "#00ADD8",
    "Python": "#3572A5",
    "JavaScript": "#f1e05a",
    "TypeScript": "#3178c6",
    "Java": "#b07219",
    "C": "#555555",
    "C++": "#f34b7d",
    "C#": "#178600",
    "Ruby": "#701516",
    "PHP": "#4F5D95",
    "Swift": "#F05138",
    "Kotlin": "#A97BFF",
    "Dart": "#00B4AB",
    "Scala": "#c22d40",
    "Shell": "#89e051",
    "Lua": "#000080",
    "HTML": "#e34c26",
    "CSS": "#563d7c",
    "Vue": "#41b883",
    "Svelte": "#ff3e00",
    "Zig": "#ec915c",
    "Nix": "#7e7eff",
    "Dockerfile": "#384d54",
    "Makefile": "#427819",
    "YAML": "#cb171e",
    "TOML": "#9c4221",
    "Markdown": "#083fa1",
}
DEFAULT_COLOR = "#858585"


def color_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k.lower(), v) for k, v in COLORS.items()], "color_key STRING, color STRING")


def with_color(rows: DataFrame) -> DataFrame:
    """Add the ``color`` of ``language``, in any case; the table is a constant and is broadcast."""
    dim = F.broadcast(color_dim(rows.sparkSession))
    joined = rows.withColumn("color_key", ascii_lower(F.col("language"))).join(dim, "color_key", "left")
    return joined.withColumn("color", F.coalesce("color", F.lit(DEFAULT_COLOR))).drop("color_key")
