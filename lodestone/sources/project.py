"""What a project is made of, from its files: languages, packages, framework, workspaces, path aliases, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.files import described, glob_regex

# Framework, files that mark it and packages that mark it, in order; the first that is met counts.
FRAMEWORKS = (
    ("next.js", ("next.config.js", "next.config.mjs"), ("next",)),
    ("nuxt", ("nuxt.config.js", "nuxt.config.ts"), ("nuxt",)),
    ("react", (), ("react", "react-dom")),
    ("vue", ("vue.config.js",), ("vue",)),
    ("angular", ("angular.json",), ("@angular/core",)),
    ("svelte", ("svelte.config.js",), ("svelte",)),
    ("express", (), ("express",)),
    ("nestjs", (), ("@nestjs/core",)),
    ("fastify", (), ("fastify",)),
    ("koa", (), ("koa",)),
    ("hapi", (), ("@hapi/hapi",)),
    ("remix", (), ("@remix-run/react",)),
    ("astro", (), ("astro",)),
    ("django", ("manage.py",), ("django",)),
    ("flask", (), ("flask",)),
    ("fastapi", (), ("fastapi",)),
    ("spring", ("pom.xml",), ()),
    ("gradle", ("build.gradle", "build.gradle.kts"), ()),
    ("go-module", ("go.mod",), ()),
    ("cargo", ("Cargo.toml",), ()),
)
#: Files whose being there makes a project one of several packages.
WORKSPACE_FILES = ("lerna.json", "pnpm-workspace.yaml", "nx.json", "turbo.json", "rush.json")
SECTIONS = ("dependencies", "devDependencies", "peerDependencies")


def languages(files: DataFrame) -> DataFrame:
    """language and number of files."""
    return described(files).groupBy("language").agg(F.count("*").alias("files"))


def packages(files: DataFrame) -> DataFrame:
    """manifest (path), section, package and version of every package.json."""
    rows = files.filter(F.col("relative_path").rlike(r"(^|/)package\.json$"))
    out = None
    for s in SECTIONS:
        one = rows.select(F.col("relative_path").alias("manifest"), F.lit(s).alias("section"), F.explode(F.from_json(F.get_json_object("content", f"$.{s}"), "map<string,string>")).alias("package", "version"))
        out = one if out is None else out.unionByName(one)
    return out


def framework(files: DataFrame) -> DataFrame:
    """One row: the first framework whose file or package is there, else none."""
    spark = files.sparkSession
    marks = [(i, name, "file", x) for i, (name, fs, _) in enumerate(FRAMEWORKS) for x in fs] + [(i, name, "package", x) for i, (name, _, ps) in enumerate(FRAMEWORKS) for x in ps]
    table = F.broadcast(spark.createDataFrame(marks, "ord int, framework string, kind string, mark string"))
    have = files.select(F.lit("file").alias("kind"), F.col("relative_path").alias("mark")).unionByName(packages(files).select(F.lit("package").alias("kind"), F.col("package").alias("mark"))).distinct()
    return have.join(table, ["kind", "mark"]).agg(F.min_by("framework", "ord").alias("framework"))


# Folders that speak for a role, and patterns of texts that do.
ROLE_FOLDERS = {
    "client": "client frontend web app apps/web apps/client packages/web packages/client packages/frontend src/app src/client src/frontend src/web pages components views",
    "server": "server backend api apps/api apps/server packages/api packages/server packages/backend src/server src/api src/backend services functions lambda",
    "shared": "shared common lib libs core packages/shared packages/common packages/core src/shared src/common src/lib types utils helpers",
}
ROLE_TEXTS = {
    "client": (
        r"import.*from ['\"]react['\"]", r"import.*from ['\"]vue['\"]", r"import.*from ['\"]@angular", r"import.*from ['\"]svelte['\"]", r"usestate|useeffect|usememo",
        r"\bdom\b|document\.|window\.", r"classname=|classname:", r"onclick|onchange|onsubmit", r"<div|<span|<button|<input", r"\.module\.css|\.module\.scss",
        r"tailwind|styled-components", r"router.*navigate|usenavigation|userouter",
    ),
    "server": (
        r"express\(\)|fastify\(\)|koa\(\)", r"app\.(get|post|put|delete|patch)\s*\(", r"router\.(get|post|put|delete|patch)\s*\(", r"@controller|@get|@post|@injectable",
        r"prisma|sequelize|typeorm|mongoose", r"\.createserver|\.listen\s*\(", r"req\s*,\s*res|request\s*,\s*response", r"middleware|authentication|authorization",
        r"database|repository|service.*\{", r"sql|query\(|execute\(", r"jwt|bcrypt|passport", r"sendmail|smtp|nodemailer", r"fastapi|flask|django", r"gin\.|echo\.|fiber\.",
    ),
    "shared": (r"export\s+(interface|type)\s+\w+", r"export\s+const\s+\w+\s*=", r"\.d\.ts$", r"validation|validator|schema", r"constant|config|enum", r"util|helper|common"),
}
FOLDER_POINTS, TEXT_POINTS = 5.0, {"client": 1.0, "server": 1.0, "shared": 0.5}


def directory_scores(files: DataFrame, deepest: int = 4) -> DataFrame:
    """folder (of the top) and its points as client, server and shared: for names of folders down to a depth, and for texts."""
    rows = described(files).filter(F.col("relative_path").contains("/")).withColumn("parts", F.split("relative_path", "/"))
    upto = F.least(F.size("parts") - 1, F.lit(deepest))
    folders = rows.select(F.explode(F.transform(F.sequence(F.lit(1), upto), lambda n: F.array_join(F.slice("parts", 1, n), "/"))).alias("path")).distinct()
    points = lambda kinds: [F.coalesce(k, F.lit(0.0)).alias(r) for r, k in kinds.items()]
    named = {r: F.when(F.concat(F.lit("/"), F.lower("path"), F.lit("/")).rlike(f"/(?:{'|'.join(fs.split())})/"), FOLDER_POINTS) for r, fs in ROLE_FOLDERS.items()}
    texts = {r: sum((F.when(F.col("content").rlike(f"(?i){p}"), TEXT_POINTS[r]).otherwise(0.0) for p in ps), F.lit(0.0)) for r, ps in ROLE_TEXTS.items()}
    both = folders.select(F.substring_index("path", "/", 1).alias("folder"), *points(named)).unionByName(rows.select(F.col("parts")[0].alias("folder"), *points(texts)))
    return both.groupBy("folder").agg(*[F.sum(r).alias(r) for r in ROLE_FOLDERS])


def directory_roles(files: DataFrame) -> DataFrame:
    """folder and role of the top folders: a role of over two points that has over two fifths of all, client before server before
    shared; else the larger one of client and server, if over two points. Where no folder is client or server, src is what
    its own folders are, or both."""
    scores = directory_scores(files)
    total = F.col("client") + F.col("server") + F.col("shared")
    role = F.coalesce(*[F.when((F.col(r) > 0.4 * total) & (F.col(r) > 2), r) for r in ROLE_FOLDERS], F.when((F.col("client") > F.col("server")) & (F.col("client") > 2), "client"), F.when((F.col("server") > F.col("client")) & (F.col("server") > 2), "server"))
    found = scores.select("folder", role.alias("role")).filter("role is not null")
    inner = described(files).select(F.lower(F.regexp_extract("relative_path", r"^src/([^/]+)/", 1)).alias("name")).filter("name <> ''")
    role = F.when(F.col("name").isin("app", "pages", "components", "views"), "client").when(F.col("name").isin("api", "server", "controllers", "routes"), "server")
    signs = inner.select(F.lit(0).alias("side"), F.lit(1).alias("inner"), role.alias("role")).unionByName(found.filter("role <> 'shared'").select(F.lit(1).alias("side"), F.lit(0).alias("inner"), F.lit(None).cast("string").alias("role")))
    signs = signs.agg(F.sum("side").alias("sides"), F.sum("inner").alias("inner"), F.min("role").alias("role")).filter("sides = 0 and inner > 0")
    guess = signs.select(F.lit("src").alias("folder"), F.explode(F.when(F.col("role").isNull(), F.array(F.lit("client"), F.lit("server"))).otherwise(F.array("role"))).alias("role"))
    return found.unionByName(guess)


def workspaces(files: DataFrame) -> DataFrame:
    """path and why of everything that marks a project of several packages."""
    marker = files.filter(F.col("relative_path").isin(*WORKSPACE_FILES)).select(F.col("relative_path").alias("path"), F.lit("marker").alias("why"))
    inner = files.filter(F.col("relative_path").rlike(r"^(packages|apps)/[^/]+/package\.json$")).select(F.regexp_replace("relative_path", r"/package\.json$", "").alias("path"), F.lit("folder").alias("why"))
    listed = files.filter(F.col("relative_path") == "package.json").select(F.explode(F.from_json(F.get_json_object("content", "$.workspaces"), "array<string>")).alias("path"), F.lit("listed").alias("why"))
    return marker.unionByName(inner).unionByName(listed)


def aliases(files: DataFrame) -> DataFrame:
    """prefix and folder of the path aliases of tsconfig.json: the first target of each, below baseUrl, without its *."""
    rows = files.filter(F.col("relative_path").rlike(r"(^|/)tsconfig\.json$"))
    base = F.regexp_replace(F.coalesce(F.get_json_object("content", "$.compilerOptions.baseUrl"), F.lit("")), r"^\./?|^\.$", "")
    paths = F.from_json(F.get_json_object("content", "$.compilerOptions.paths"), "map<string,array<string>>")
    d = rows.select(base.alias("base"), F.explode(paths).alias("prefix", "targets")).filter(F.size("targets") > 0)
    target = F.regexp_replace(F.regexp_replace(F.col("targets")[0], r"\*$", ""), r"^\./", "")
    return d.select(F.regexp_replace("prefix", r"\*$", "").alias("prefix"), F.when(F.col("base") == "", target).otherwise(F.concat_ws("/", F.rtrim(F.col("base"), F.lit("/")), target)).alias("folder"))


def missing_packages(deps: DataFrame, files: DataFrame, builtin: tuple[str, ...] = ("fs", "path", "os", "http", "https", "url", "util", "crypto", "events", "stream", "child_process")) -> DataFrame:
    """deps whose target is a package (its scope kept) that no package.json lists."""
    bare = deps.filter(~F.col("target").rlike(r"^[./~#@]/|^\.|^/|^~|^node:|^virtual:"))
    name = F.when(F.col("target").startswith("@"), F.regexp_extract("target", r"^(@[^/]+/[^/]+)", 1)).otherwise(F.substring_index("target", "/", 1))
    return bare.withColumn("package", name).filter(~F.col("package").isin(*builtin)).join(packages(files).select("package").distinct(), "package", "left_anti")


SETTINGS = "name string, root string, languages array<string>, layers array<struct<name:string,type:string,directories:array<string>,allowedDependencies:array<string>>>, rules struct<level:string,settings:map<string,string>,builtin:map<string,string>>, patterns struct<include:array<string>,exclude:array<string>>"


def settings(files: DataFrame, name: str = "lodestone.config.json") -> DataFrame:
    """The project's settings file as columns; no row without one."""
    return files.filter(F.col("relative_path") == name).select(F.from_json("content", SETTINGS).alias("s")).select("s.*")


def chosen(files: DataFrame, config: DataFrame) -> DataFrame:
    """The files that the settings' include patterns take and its exclude patterns leave."""
    row = config.select("patterns.include", "patterns.exclude").first()
    out = files
    if row and row["include"]:
        out = out.filter(F.col("relative_path").rlike("|".join(map(glob_regex, row["include"]))))
    if row and row["exclude"]:
        out = out.filter(~F.col("relative_path").rlike("|".join(map(glob_regex, row["exclude"]))))
    return out
