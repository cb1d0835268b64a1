"""Path, package and content predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each language's corpus takes by extension and by whole name, the folders it
#: leaves out, and the names of generated scripts.
EXTENSIONS = {
    "python": ("py",),
    "rust": ("rs",),
    "typescript": ("ts", "tsx", "mts", "cts"),
    "javascript": ("js", "mjs", "cjs", "jsx"),
    "java": ("java",),
    "bash": ("sh", "bash", "ebuild", "eclass"),
    "c": ("c", "h"),
    "cpp": ("cc", "cpp", "cxx", "c++", "hpp", "hh", "hxx", "h++", "ipp", "tcc", "inl", "h"),
    "ruby": ("rb", "rake", "gemspec", "ru", "gemfile", "rbi", "eye", "podspec", "god", "jbuilder"),
    "zig": ("zig", "zon"),
}
FILE_NAMES = {
    "bash": (".bashrc", ".bash_profile"),
    "ruby": (
        "Rakefile", "rakefile", "Gemfile", "Guardfile", "Appraisals", "Steepfile", "Dangerfile", "Capfile",
        "Brewfile", "Vagrantfile", "Thorfile", "Fastfile", "Berksfile", "Puppetfile", "Podfile", ".simplecov",
    ),
}
LEFT_OUT = {"python": ("_vendor", "_vendored"), "ruby": ("vendor",)}
MINIFIED = (".min.js", ".min.mjs", ".min.cjs")
#: Statement words that make a text a template, and interpreters that are a shell.
TEMPLATE_WORDS = (
    "if", "elif", "else", "endif", "for", "endfor", "set", "endset", "from", "import", "include", "extends", "macro",
    "endmacro", "call", "endcall", "block", "endblock", "filter", "endfilter", "raw", "endraw", "with", "endwith", "autoescape",
)
SHELLS = ("sh", "bash", "dash")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """After the last dot of the file name; empty without one, or if it only leads the name."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def takes(path: Column, language: str) -> Column:
    """Whether a language's corpus takes a file by its path.  Headers are candidates for C and C++
    and names without an extension for the shell: their content decides."""
    out = extension(path).isin(*EXTENSIONS[language])
    if language in FILE_NAMES:
        out = out | file_name(path).isin(*FILE_NAMES[language])
    if language == "bash":
        out = out | ~file_name(path).rlike(r"^.+\.")
    if language in LEFT_OUT:
        out = out & ~path.rlike(r"(^|/)(" + "|".join(LEFT_OUT[language]) + r")(/|$)")
    if language == "javascript":
        for end in MINIFIED:
            out = out & ~path.endswith(end)
    return out


def dialect(path: Column, language: str) -> Column:
    """``tsx`` where TypeScript files need that reading, else null."""
    return F.when(extension(path) == "tsx", "tsx") if language == "typescript" else F.lit(None).cast("string")


def languages_of(path: Column) -> Column:
    """All languages whose corpus takes the path, in registry order."""
    return F.array_compact(F.array(*(F.when(takes(path, x), x) for x in EXTENSIONS)))


def pkg_dir(name: Column, version: Column) -> Column:
    return F.concat(F.regexp_replace(name, "[/:]", "__"), F.lit("-"), version)


def package_of(pkgdir: Column) -> Column:
    return F.regexp_replace(pkgdir, "-[^-]*$", "")


def is_safe(path: Column) -> Column:
    return (path != "") & ~path.rlike(r"(^|/)(\.{1,2})?(/|$)")


def is_sha256(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{64}$")


def has_nul(content: Column) -> Column:
    return F.position(F.unhex(F.lit("00")), content) > 0


def interpreter(first_line: Column) -> Column:
    """Base name of a shebang's program, or of what ``env`` runs, flags passed over; else empty."""
    program = F.regexp_replace(F.regexp_extract(first_line, r"^#!\s*(\S+)", 1), "^.*/", "")
    run = F.regexp_replace(F.regexp_extract(first_line, r"^#!\s*\S+(?:\s+-\S*)*\s+([^-\s]\S*)", 1), "^.*/", "")
    return F.when(program == "env", run).otherwise(program)


def is_shell(path: Column, text: Column) -> Column:
    """No template and no NUL; by the shebang if there is one, else by name or extension."""
    program = interpreter(F.substring_index(text, "\n", 1))
    named = file_name(path).isin(*FILE_NAMES["bash"]) | extension(path).isin(*EXTENSIONS["bash"])
    return ~is_template(text) & (F.instr(text, "\0") == 0) & F.when(program != "", program.isin(*SHELLS)).otherwise(named)


def is_template(text: Column) -> Column:
    """A ``{%`` or ``{%-`` tag that begins with a statement word, anywhere."""
    return text.rlike(r"\{%-?[ \t\r\n]*(" + "|".join(TEMPLATE_WORDS) + r")(?![A-Za-z0-9_])")


def relative_to(path: Column, root: str) -> Column:
    return F.when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 1 << 30)).otherwise(path)


def sloc_language(c: Column, cpp: Column, sh: Column) -> Column:
    """c, cpp, bash or null by lines of code; the first two exclude each other."""
    c, cpp, sh = (F.coalesce(x, F.lit(0)) for x in (c, cpp, sh))
    return F.when((c >= 2000) & (c >= cpp), "c").when((cpp >= 2000) & (cpp > c), "cpp").when(sh >= 500, "bash")


def version_key(version: Column) -> Column:
    """Sortable key of a version: its runs of digits and of other characters, as number and text.

    Text counts as number 0, and so does a number that 64 bits can't hold; fewer runs come first.
    """

    def part(p: Column) -> Column:
        n = p.try_cast("decimal(38,0)")
        return F.struct(F.when(p.rlike("^[0-9]") & (n < F.lit("18446744073709551616").cast("decimal(38,0)")), n).otherwise(F.lit(0)).cast("decimal(38,0)").alias("n"), F.when(p.rlike("^[0-9]"), "").otherwise(p).alias("t"))

    return F.transform(F.regexp_extract_all(version, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1)), part)
