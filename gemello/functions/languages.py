"""The language of a file, and whether a file can be compared by structure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gemello.functions.strings import extname

# Languages in order of precedence, with their most common file name patterns. More can be given as a parameter.
GLOBS: dict[str, str] = {
    "Ada": "*.ada *.adb *.ads",
    "Apex": "*.apexc *.trigger",
    "Assembly": "*.asm *.s *.S",
    "Bash": "*.bash *.bats *.ksh *.sh *.zsh .bash_profile .bashrc .env .profile .zshrc PKGBUILD",
    "C": "*.c",
    "C++": "*.cc *.cpp *.c++ *.cxx *.cu *.h *.hh *.hpp *.hxx *.inl *.ino",
    "C#": "*.cs",
    "Clojure": "*.bb *.boot *.clj *.cljc *.cljs *.edn",
    "CMake": "*.cmake *.cmake.in CMakeLists.txt",
    "Common Lisp": "*.lisp *.lsp *.asd",
    "CSS": "*.css",
    "Dart": "*.dart",
    "Device Tree": "*.dts *.dtsi *.dtso *.its",
    "Dockerfile": "Dockerfile Containerfile Dockerfile.* *.dockerfile",
    "Elixir": "*.ex *.exs",
    "Elm": "*.elm",
    "Emacs Lisp": "*.el .emacs _emacs Cask",
    "Erlang": "*.erl *.hrl *.escript rebar.config",
    "F#": "*.fs *.fsx *.fsi",
    "Fish": "*.fish",
    "Fortran": "*.f *.for *.f90",
    "Gleam": "*.gleam",
    "Go": "*.go",
    "Haskell": "*.hs",
    "HCL": "*.hcl *.nomad *.tf *.tfvars",
    "HTML": "*.html *.htm *.xhtml",
    "Janet": "*.janet *.jdn",
    "Java": "*.java",
    "JavaScript": "*.cjs *.js *.mjs *.snap",
    "JSON": "*.json *.avsc *.geojson *.har *.ipynb *.jsonl *.tfstate *.webmanifest Pipfile.lock composer.lock flake.lock",
    "JavaScript JSX": "*.jsx",
    "Julia": "*.jl",
    "Kotlin": "*.kt *.ktm *.kts",
    "LaTeX": "*.aux *.cls *.sty *.tex",
    "Lua": "*.lua",
    "Make": "*.mak *.make *.mk GNUmakefile Makefile makefile Makefile.am Makefile*.in",
    "Newick": "*.nhx *.nwk *.nh",
    "Nix": "*.nix",
    "Objective-C": "*.m",
    "OCaml": "*.ml",
    "OCaml Interface": "*.mli",
    "Pascal": "*.pas *.dfm *.dpr",
    "Perl": "*.pm *.pl",
    "PHP": "*.php *.phtml",
    "Proto": "*.proto",
    "Python": "*.py *.py3 *.pyi *.bzl TARGETS BUCK DEPS",
    "QML": "*.qml",
    "R": "*.R *.r *.rd .Rprofile",
    "Racket": "*.rkt",
    "Ruby": "*.rb *.builder *.rake Gemfile Rakefile",
    "Rust": "*.rs",
    "Scala": "*.scala *.sbt *.sc",
    "Scheme": "*.scm *.sch *.ss",
    "Smali": "*.smali",
    "Solidity": "*.sol",
    "SQL": "*.sql *.pgsql",
    "Swift": "*.swift",
    "TOML": "*.toml Cargo.lock Gopkg.lock Pipfile poetry.lock uv.lock",
    "TypeScript": "*.ts *.cts *.mts",
    "TypeScript TSX": "*.tsx",
    "Verilog": "*.v *.sv *.vh",
    "VHDL": "*.vhdl *.vhd",
    "XML": "*.xml *.csproj *.plist *.svg *.xsd *.xsl *.xslt",
    "YAML": "*.yaml *.yml yarn.lock CITATION.cff",
    "Zig": "*.zig",
}

# Interpreters of a first line.
SHEBANGS: dict[str, str] = {
    "Bash": "ash bash dash ksh mksh pdksh rc sh zsh",
    "C": "tcc",
    "Common Lisp": "lisp sbcl ccl clisp ecl",
    "Elixir": "elixir",
    "Erlang": "escript",
    "Fish": "fish",
    "Haskell": "runghc runhaskell runhugs",
    "JavaScript": "chakra d8 gjs js node nodejs qjs rhino v8 v8-shell",
    "OCaml": "ocaml ocamlrun ocamlscript",
    "Perl": "perl",
    "Python": "python python2 python3",
    "R": "Rscript",
    "Ruby": "ruby macruby rake jruby rbx",
    "Swift": "swift",
    "TypeScript": "deno ts-node",
}

# Editor modes whose name isn't the language's own in lower case.
MODES: dict[str, str] = {
    "csharp": "C#", "emacs-lisp": "Emacs Lisp", "fsharp": "F#", "js": "JavaScript", "js2": "JavaScript", "lisp": "Common Lisp", "nxml": "XML",
    "objc": "Objective-C", "rjsx": "JavaScript JSX", "sh": "Bash", "tuareg": "OCaml",
}
OWN_MODES = "Ada C Clojure CSS Dart C++ Elixir Elm Fish Fortran Gleam Go Haskell HCL HTML Janet Java Perl Python Racket Ruby Rust Scala Solidity SQL Swift TOML TypeScript Verilog VHDL YAML Zig".split()

#: Languages whose sliders prefer the outer delimiter.
OUTER_SLIDERS = ("Clojure", "Common Lisp", "Emacs Lisp", "HCL", "Janet", "JSON", "Newick", "Racket", "Scheme", "SQL", "TOML")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def glob_regex(glob: str) -> str:
    """An anchored pattern for a file name glob of * and ?."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c in "_-" else "\\" + c for c in glob) + "$"


def by_mode(text: Column) -> Column:
    """By an editor mode line among the first two lines."""
    modes = {**{m.lower(): m for m in OWN_MODES}, **MODES}
    out = F.lit(None).cast("string")
    for k in (1, 0):  # the first line wins
        line = F.coalesce(F.get(F.split(text, "\n"), F.lit(k)), F.lit(""))
        full = F.regexp_extract(line, r"-\*- *mode: *([a-zA-Z0-9_+-]+).*-\*-", 1)
        name = F.when(full != "", full).otherwise(F.regexp_extract(line, r"-\*-(.+)-\*-", 1))
        out = F.coalesce(_lookup(modes, F.trim(F.lower(name))), out)
    return out


def by_shebang(text: Column) -> Column:
    """By the base name of the interpreter of the first line."""
    path = F.regexp_extract(F.regexp_extract(text, "^([^\n]*)", 1), r"^#! *(?:/usr/bin/env )?([^ \r]+)", 1)
    names = {i: lang for lang, own in SHEBANGS.items() for i in own.split()}
    return _lookup(names, F.regexp_extract(path, "([^/]*)/?$", 1))


def by_name(path: Column, globs: dict[str, str] | None = None) -> Column:
    """By file name patterns, the first language in order: a lookup by name or extension for plain patterns, else a match."""
    table = GLOBS if globs is None else globs
    name = F.regexp_extract(path, "([^/]*)$", 1)
    order = {lang: k for k, lang in enumerate(table)}
    suffixes, names, rest = {}, {}, []
    for lang, own in table.items():
        for g in own.split():
            if g.startswith("*.") and not set("*?") & set(g[2:]) and "." not in g[2:]:
                suffixes.setdefault(g[1:], lang)
            elif not set("*?") & set(g):
                names.setdefault(g, lang)
            else:
                rest.append((g, lang))
    suffix = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    found = [_lookup(names, name), _lookup(suffixes, suffix), *(F.when(name.rlike(glob_regex(g)), F.lit(lang)) for g, lang in rest)]
    rank = lambda c: F.coalesce(_lookup({k: f"{v:04d}" for k, v in order.items()}, F.coalesce(c, F.lit(""))), F.lit("9999"))
    best = F.array_min(F.array(*[F.struct(rank(c).alias("rank"), c.alias("language")) for c in found]))
    return best["language"]


def looks_like_objc(path: Column, text: Column) -> Column:
    """A header one of whose first 100 lines starts with a keyword of Objective-C."""
    keyword = F.exists(F.slice(F.split(text, "\n"), 1, 100), lambda x: x.rlike("^(?:#import|@interface|@protocol)"))
    return (extname(path) == ".h") & keyword


def guess(path: Column, text: Column, overrides: list[tuple[str, str]] = (), globs: dict[str, str] | None = None) -> Column:
    """The language of a file, null for plain text: overrides (glob, language or "text") first, then what the text says, then its name."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    hack = path.endswith(".php") & text.startswith("<?hh")
    named = F.when(~hack, F.coalesce(F.when(looks_like_objc(path, text), "Objective-C"), by_name(path, globs), F.when(text.startswith("<?xml"), "XML")))
    out = F.coalesce(by_mode(text), by_shebang(text), named)
    for glob, language in reversed(overrides):
        out = F.when(name.rlike(glob_regex(glob)), F.lit(None if language == "text" else language)).otherwise(out)
    return out


def parse_override(text: str) -> tuple[str, str]:
    """GLOB:LANGUAGE by the last colon; the language in any case, "text" for plain text."""
    glob, colon, name = text.rpartition(":")
    if not colon:
        raise ValueError(f"expected GLOB:LANGUAGE, not {text!r}")
    known = {x.lower(): x for x in [*GLOBS, "text"]}
    if name.lower() not in known:
        raise ValueError(f"no such language: {name!r}")
    return glob, known[name.lower()]


def prefers_outer(language: Column) -> Column:
    return language.isin(*OUTER_SLIDERS)


def atom_kind(capture: Column) -> Column:
    """The kind of an atom by the name of its highlight capture."""
    return (
        F.when(capture.startswith("comment"), "comment")
        .when(capture.startswith("string") | capture.startswith("character"), "string")
        .when(capture.startswith("keyword") | capture.isin("conditional", "repeat", "include", "exception", "operator.keyword"), "keyword")
        .when(capture.startswith("type") | (capture == "constructor"), "type")
        .otherwise("normal")
    )


def over_limit(lhs: Column, rhs: Column, limit: int) -> tuple[Column, Column]:
    """Whether either side has more bytes than the limit, and the bytes of the larger."""
    size = F.greatest(F.octet_length(lhs), F.octet_length(rhs))
    return size > limit, size.cast("long")


def static_fallback(hidden: Column, generated: Column, language: Column, lhs: Column, rhs: Column, limit: int) -> Column:
    """Why a file is compared by lines, as far as that can be said before parsing; structural if it isn't."""
    return (
        F.when(hidden, "hidden").when(generated, "generated").when(language.isNull(), "unsupported_language").when(over_limit(lhs, rhs, limit)[0], "too_large").otherwise("structural")
    )
