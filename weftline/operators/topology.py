"""Tables of trees: Newick text, nodes, splits, neighbourhoods, and the scores of many topologies in one plan.

A tree has three forms. As text it is a Newick string. As rows it is ``nodes``: (tree, node, parent, length, name, comment),
where a node's number is that of its last token, so that nodes are in postorder. As a program it is one row (tree, steps):
its nodes in postorder, each with the number of its children, which a stack can run. A subtree is a slice of the program.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.sources.shared import cut

#: What stands before a bracket, comma or semicolon; brackets within comments do not count. An open comment ends a token.
TOKEN = r"[^(),;\[]*(?:\[[^\]]*\][^(),;\[]*)*(?:[(),;\[]|$)"
LABEL = r"^([^:\[]*)((?:\[[^\]]*\])?)((?::[^:\[]*)?)$"
LENGTH = r"^:[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
SEEDS = (11, 47)


def tokens(strings: DataFrame, tree: str = "tree", newick: str = "newick", arity: str = "any") -> DataFrame:
    """tree, at, place, text, mark, depth, opened, name, comment, length, fault: the tokens of each string in order.

    ``text`` stands before ``mark``, a bracket, comma or semicolon. A mark other than an opening bracket ends a node, which
    ``text`` describes; ``depth`` is that of the node, ``opened`` whether brackets stand before its text. ``fault`` says
    what is wrong with the token. Null strings count as empty.
    """
    rows = strings.select(F.col(tree).alias("tree"), F.coalesce(F.col(newick), F.lit("")).alias("s"))
    found = rows.select("tree", F.length("s").alias("size"), F.posexplode(F.regexp_extract_all("s", F.lit(TOKEN), F.lit(0))).alias("at", "token"))
    found = found.withColumn("at", F.col("at").cast("long"))
    order = Window.partitionBy("tree").orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.substring("token", -1, 1)
    found = found.withColumn("mark", F.when(last.isin("(", ")", ",", ";", "["), last).otherwise(""))
    step = F.when(F.col("mark") == "(", 1).when(F.col("mark") == ")", -1).otherwise(0)
    found = found.select("*", F.coalesce(F.sum(F.length("token")).over(before), F.lit(0)).cast("long").alias("place"), F.coalesce(F.sum(step).over(before), F.lit(0)).cast("long").alias("depth"), F.lag("mark").over(order).alias("previous"))
    text = F.expr("substring(token, 1, length(token) - length(mark))")
    part = lambda k: F.regexp_extract("text", LABEL, k)
    found = found.withColumn("text", text).withColumns({"opened": F.coalesce(F.col("previous") == ")", F.lit(False)), "name": part(1), "comment": part(2), "_length": part(3)})
    # the text after the last mark is empty where all is well
    ended, closing = (F.col("mark") == "") & (F.col("text") == "") & (F.col("previous") == ";"), F.col("mark").isin(")", ",", ";")
    fault = (
        F.when(ended, None)
        .when(F.col("previous") == ";", "text after the semicolon")
        .when(F.col("mark") == "", "no semicolon at the end")
        .when(F.col("mark") == "[", "a comment without an end")
        .when((F.col("mark") == "(") & F.col("opened"), "a bracket after a closed one")
        .when((F.col("mark") == "(") & (F.col("text") != ""), "a name before a bracket")
        .when(F.col("mark").isin(")", ",") & (F.col("depth") <= 0), "no bracket is open")
        .when((F.col("mark") == ";") & (F.col("depth") != 0), "a bracket is not closed")
        .when(closing & ~F.col("text").rlike(LABEL), "not a name, a comment and a length")
        .when(closing & ~F.col("opened") & (F.col("name") == ""), "a leaf without a name")
        .when(closing & (F.col("_length") != "") & ~F.col("_length").rlike(LENGTH), "not a length")
    )
    # faults of the mark lie behind the text
    at_mark = F.col("fault").isin("no semicolon at the end", "a comment without an end", "no bracket is open", "a bracket is not closed")
    length = F.when(F.col("_length").rlike(LENGTH), F.expr("cast(substring(_length, 2) as double)"))
    found = found.where(~F.coalesce(ended, F.lit(False))).withColumns({"fault": fault, "length": length})
    found = found.withColumn("place", F.when(at_mark, F.col("place") + F.length("text")).otherwise(F.col("place")).cast("long"))
    if arity == "any":
        return found.drop("_length", "previous", "token", "size")
    if arity not in ("binary", "unrooted"):
        raise ValueError("arity is any, binary or unrooted")
    # an inner node's children end at its own depth + 1 after its opening bracket
    kids = F.sum(F.when(F.col("mark").isin(",", ")"), 1).otherwise(0)).over(Window.partitionBy("tree", "depth", "level").orderBy("at"))
    level = F.sum(F.when(F.col("mark") == "(", 1).otherwise(0)).over(Window.partitionBy("tree", "of").orderBy("at"))
    # brackets that open at depth d count levels of depth d + 1
    counted = found.withColumn("of", F.when(F.col("mark") == "(", F.col("depth") + 1).otherwise(F.col("depth"))).withColumn("level", level).withColumn("kids", kids)
    wanted = F.when((F.col("depth") == 1) & (F.lit(arity) == "unrooted"), 3).otherwise(2)
    wrong = F.when((F.col("mark") == ")") & (F.col("kids") != wanted), F.lit("not the number of children that this arity has"))
    return counted.withColumn("fault", F.coalesce("fault", wrong)).drop("_length", "previous", "token", "size", "of", "level", "kids")


def _judged(strings: DataFrame, tree: str, newick: str, arity: str) -> DataFrame:
    whole = Window.partitionBy("tree")
    found = tokens(strings, tree, newick, arity)
    return found.withColumn("first", F.min(F.when(F.col("fault").isNotNull(), F.struct("place", "fault"))).over(whole))


def refused(strings: DataFrame, tree: str = "tree", newick: str = "newick", arity: str = "any") -> DataFrame:
    """tree, place, fault: the malformed strings and where (from 0) and what their first fault is."""
    found = _judged(strings, tree, newick, arity).where("first is not null and fault is not null and place = first.place")
    return found.groupBy("tree").agg(F.min("first.place").alias("place"), F.min("first.fault").alias("fault"))


def parsed(strings: DataFrame, tree: str = "tree", newick: str = "newick", arity: str = "any") -> DataFrame:
    """tree, node, parent, length, name, comment: the nodes of the strings that are well-formed; ``refused`` has the others.

    ``arity`` any takes all trees, binary those whose inner nodes have two children, unrooted those whose root has three
    and whose other inner nodes have two. A tree's string is one row, and its tokens are one window; trees are dealt out.
    Names, inner ones too, may be empty or repeat; leaves have one. The root has no parent; a length that is not given is
    null. ``tree`` names a string: strings of one name are not told apart.
    """
    found = _judged(strings, tree, newick, arity).where("first is null")
    # the bracket that closes a node's level is the next one there; the parent's text follows it
    level = Window.partitionBy("tree", "depth").orderBy("at").rowsBetween(0, Window.unboundedFollowing)
    closing = F.min(F.when(F.col("mark") == ")", F.col("at"))).over(level)
    nodes = found.withColumn("closing", closing).where(F.col("mark").isin(")", ",", ";"))
    return nodes.select("tree", F.col("at").alias("node"), (F.col("closing") + 1).alias("parent"), "length", "name", "comment")


def programs(nodes: DataFrame) -> DataFrame:
    """tree, steps: the nodes of each tree in postorder, as (node, kids, length, name, comment).

    The numbers of ``nodes`` must be in postorder, as ``parsed`` makes them and ``toured`` does for others.
    """
    kids = nodes.where("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").cast("int").alias("kids"))
    met = nodes.join(kids, ["tree", "node"], "left").select("tree", F.struct("node", F.coalesce("kids", F.lit(0)).alias("kids"), "length", "name", "comment").alias("step"))
    return met.groupBy("tree").agg(F.array_sort(F.collect_list("step")).alias("steps"))


def folded(steps: Column, leaf, inner, empty: str) -> Column:  # noqa: ANN001
    """The value of a program's root: ``leaf(step)`` of leaves, ``inner(values, step)`` of the values of a node's children.

    ``empty`` is the SQL type of values. What is on the stack is handed on by reference, so that a step costs its children.
    """

    def step(stack: Column, s: Column) -> Column:
        n = F.size(stack)
        below = F.when(n == s["kids"], F.array().cast(f"array<{empty}>")).otherwise(F.slice(stack, F.lit(1), n - s["kids"]))
        mine = F.slice(stack, n - s["kids"] + 1, F.greatest(s["kids"], F.lit(1)))
        return F.when(s["kids"] == 0, F.concat(stack, F.array(leaf(s)))).otherwise(F.concat(below, F.array(inner(mine, s))))

    return F.aggregate(steps, F.array().cast(f"array<{empty}>"), step, lambda stack: stack[0])


def newick(trees: DataFrame) -> DataFrame:
    """tree, newick: the strings of programs. Whole lengths are written as Spark writes doubles."""
    label = lambda s: F.concat(s["name"], F.coalesce(s["comment"], F.lit("")), F.coalesce(F.concat(F.lit(":"), s["length"].cast("string")), F.lit("")))
    text = folded(F.col("steps"), label, lambda kids, s: F.concat(F.lit("("), F.array_join(kids, ","), F.lit(")"), label(s)), "string")
    return trees.select("tree", F.concat(text, F.lit(";")).alias("newick"))


def _hashes(name: Column) -> Column:
    return F.struct(*(F.xxhash64(F.lit(seed), name).alias(f"h{k}") for k, seed in enumerate(SEEDS)))


def sized(trees: DataFrame) -> DataFrame:
    """``trees`` with ``sizes``: how many steps the subtree of each step has, itself included."""
    state = "struct<stack:array<int>,sizes:array<int>>"

    def step(acc: Column, s: Column) -> Column:
        stack, n = acc["stack"], F.size(acc["stack"])
        mine = F.aggregate(F.slice(stack, n - s["kids"] + 1, F.greatest(s["kids"], F.lit(1))), F.lit(1), lambda a, x: a + x)
        own = F.when(s["kids"] == 0, F.lit(1)).otherwise(mine)
        below = F.when(n == s["kids"], F.array().cast("array<int>")).otherwise(F.slice(stack, F.lit(1), n - s["kids"]))
        return F.struct(F.concat(F.when(s["kids"] == 0, stack).otherwise(below), F.array(own)).alias("stack"), F.concat(acc["sizes"], F.array(own)).alias("sizes"))

    start = F.struct(F.array().cast("array<int>").alias("stack"), F.array().cast("array<int>").alias("sizes")).cast(state)
    return trees.withColumn("sizes", F.aggregate("steps", start, step, lambda acc: acc["sizes"]))


def subtrees(trees: DataFrame) -> DataFrame:
    """tree, node, first: the steps from number ``first`` to ``node`` (places in the program, from 0) are a subtree."""
    return sized(trees).select("tree", F.posexplode("sizes").alias("node", "size")).select("tree", "node", (F.col("node") - F.col("size") + 1).alias("first"))


def splits(trees: DataFrame) -> DataFrame:
    """tree, h0, h1, n: the splits of each tree's leaves by its branches, each once.

    A split is known by a 128-bit hash of the names on the side that lacks the least name, and n is how many leaves are
    there. Hashes of names are laid over each other by exclusive or along the program, so that the leaves under a node are
    one difference of two running values, and rows are as many as nodes. The whole tree is no split; leaves are. Names that
    a tree repeats count as one leaf each.
    """
    steps = sized(trees).select("tree", F.posexplode(F.arrays_zip("steps", "sizes")).alias("at", "e")).select("tree", "at", (F.col("at") - F.col("e.sizes") + 1).alias("first"), F.col("e.steps.name").alias("name"), (F.col("e.steps.kids") == 0).alias("leaf"))
    own = steps.withColumn("h", F.when(F.col("leaf"), _hashes(F.col("name"))))
    upto = Window.partitionBy("tree").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("tree")
    run = lambda x: F.coalesce(F.bit_xor(x).over(upto), F.lit(0).cast("long"))
    least = F.min(F.when(F.col("leaf"), F.struct("name", "at"))).over(whole)
    laid = own.select("tree", "at", "first", run("h.h0").alias("x0"), run("h.h1").alias("x1"), F.count("h").over(upto).alias("leaves"), F.count("h").over(whole).alias("all"), least["at"].alias("anchor"), F.coalesce(F.bit_xor("h.h0").over(whole), F.lit(0)).alias("t0"), F.coalesce(F.bit_xor("h.h1").over(whole), F.lit(0)).alias("t1"))
    # what ran up to the step before the subtree's first
    earlier = laid.select("tree", (F.col("at") + 1).alias("first"), F.col("x0").alias("y0"), F.col("x1").alias("y1"), F.col("leaves").alias("z"))
    met = laid.join(earlier, ["tree", "first"], "left").fillna(0, ["y0", "y1", "z"])
    holds = (F.col("first") <= F.col("anchor")) & (F.col("anchor") <= F.col("at"))
    flip = lambda x, t: F.when(holds, x.bitwiseXOR(F.col(t))).otherwise(x)
    n = F.col("leaves") - F.col("z")
    out = met.select("tree", flip(F.col("x0").bitwiseXOR(F.col("y0")), "t0").alias("h0"), flip(F.col("x1").bitwiseXOR(F.col("y1")), "t1").alias("h1"), F.when(holds, F.col("all") - n).otherwise(n).alias("n"))
    return out.where("n > 0").distinct()


def topology_keys(trees: DataFrame) -> DataFrame:
    """tree, key: a 128-bit hash of the tree's splits; trees of one key are the same unrooted tree."""
    of = F.array_sort(F.collect_list(F.struct("h0", "h1")))
    return splits(trees).groupBy("tree").agg(of.alias("s")).select("tree", F.sha2(F.to_json("s"), 256).substr(1, 32).alias("key"))


def nni_neighbours(trees: DataFrame) -> DataFrame:
    """tree, branch, swap, steps: the trees that one interchange over a branch between inner nodes makes, 2 (n - 3) of n leaves.

    Trees are unrooted: the root has three children, other inner nodes two. Over the branch above node ``branch``, its
    sibling (the first one under the root) changes places with one of its two children. Both subtrees are slices of the
    program and lie apart, so that the new program is five slices put together; no step meets another row.
    """
    at = sized(trees).select("tree", "steps", "sizes", F.explode(F.sequence(F.lit(0), F.size("steps") - 1)).alias("branch"))
    at = at.where((F.col("steps")[F.col("branch")]["kids"] > 0) & (F.col("branch") < F.size("steps") - 1))
    size = lambda k: F.col("sizes")[k]
    # the branch's last child ends just before it, the other before that
    last = F.col("branch") - 1
    other = last - size(last)
    at = at.select("*", F.explode(F.array(F.struct(F.lit(0).alias("swap"), other.alias("b")), F.struct(F.lit(1).alias("swap"), last.alias("b")))).alias("e")).select("*", "e.swap", "e.b").drop("e")
    begin = F.col("branch") - size(F.col("branch")) + 1
    # a sibling before the branch ends where the branch begins, one after it starts behind it
    parent = F.filter(F.sequence(F.col("branch") + 1, F.size("steps") - 1), lambda x: x - F.col("sizes")[x] + 1 <= begin)[0]
    at = at.withColumns({"begin": begin, "parent": parent})
    start = F.col("parent") - size(F.col("parent")) + 1
    before = F.col("begin") > start
    following = F.filter(F.sequence(F.col("branch") + 1, F.size("steps") - 1), lambda x: x - F.col("sizes")[x] == F.col("branch"))
    # of the subtrees that start right behind the branch, the largest under the parent is the sibling
    after = F.element_at(F.filter(following, lambda x: x < F.col("parent")), -1)
    at = at.withColumn("a", F.when(before, F.col("begin") - 1).otherwise(after))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    at = at.select("tree", "branch", "swap", "steps", (low - size(low) + 1).alias("a0"), low.alias("a1"), (high - size(high) + 1).alias("b0"), high.alias("b1"))
    part = lambda x, y: F.slice("steps", x + 1, F.greatest(y - x, F.lit(0)))
    a0, a1, b0, b1 = (F.col(x) for x in ("a0", "a1", "b0", "b1"))
    return at.select("tree", "branch", "swap", F.concat(part(F.lit(0), a0), part(b0, b1 + 1), part(a1 + 1, b0), part(a0, a1 + 1), part(b1 + 1, F.size("steps"))).alias("steps"))


def spr_neighbours(trees: DataFrame, radius: int | None = None) -> DataFrame:
    """tree, node, onto, upper, steps: the other trees that cutting one branch and grafting the cut part onto another makes.

    Trees are unrooted, as for ``nni_neighbours``. The branch above ``node`` is cut; what goes is the subtree below it or, where
    ``upper``, all the rest, and it is grafted onto the branch above ``onto``, at most ``radius`` nodes away from the place
    it left. Equal trees come once, by the least (node, onto, upper): 2 (n - 3) (2 n - 7) of n leaves without a radius. The
    node at the graft has no name and no length. Each new program is put together from slices of the old one.
    """
    if radius is not None and radius < 1:
        raise ValueError("a radius is at least 1")
    every = F.sequence(F.lit(0), F.size("steps") - 1)
    size, begin = lambda k: F.get("sizes", k), lambda k: k - F.get("sizes", k) + 1
    rows = sized(trees).select("tree", "steps", "sizes")
    over = lambda k: F.filter(every, lambda j: (j >= k) & (begin(j) <= k))
    rows = rows.withColumn("depths", F.transform(every, lambda k: F.size(over(k)) - 1))
    cut_at = rows.withColumn("node", F.explode(F.sequence(F.lit(0), F.size("steps") - 2)))
    # the nodes that hold the cut one, itself first and then its parent
    cut_at = cut_at.withColumn("above", over(F.col("node"))).withColumn("p", F.get("above", F.lit(1))).withColumn("above", F.slice("above", 2, F.size("above") - 1))
    shared = lambda y: F.size(F.filter("above", lambda a: (a >= y) & (begin(a) <= y))) - 1
    depth = lambda k: F.get("depths", k)
    away = lambda y: depth(F.col("p")) - shared(y) + F.greatest(depth(y) - 1 - shared(y), F.lit(0))
    near = lambda d: (d >= 1) if radius is None else d.between(1, radius)
    inside = lambda y: (y <= F.col("node")) & (y >= begin(F.col("node")))
    lower = F.filter(F.sequence(F.lit(0), F.size("steps") - 2), lambda y: ~inside(y) & near(away(y)))
    upper = F.filter(F.sequence(F.lit(0), F.size("steps") - 2), lambda y: inside(y) & (y < F.col("node")) & near(depth(y) - 1 - depth(F.col("node"))))
    both = F.concat(F.transform(lower, lambda y: F.struct(y.alias("onto"), F.lit(False).alias("upper"))), F.transform(upper, lambda y: F.struct(y.alias("onto"), F.lit(True).alias("upper"))))
    pairs = cut_at.withColumn("e", F.explode(both)).select("tree", "node", "e.onto", "e.upper", "steps", "sizes", "p")
    node, onto = F.col("node"), F.col("onto")
    part = lambda k: F.slice("steps", begin(k) + 1, size(k))
    blank = lambda k: F.get("steps", k).withField("kids", F.lit(2)).withField("name", F.lit("")).withField("length", F.lit(None).cast("double"))
    # without the cut part its parent goes; a root that is left with two children takes those of an inner one instead
    sibling = F.get(F.filter(every, lambda k: (k != node) & (F.get("steps", k)["kids"] > 0) & (F.size(over(k)) == 2)), F.lit(0))
    goes = F.when(F.col("p") == F.size("steps") - 1, sibling).otherwise(F.col("p"))
    pairs = pairs.withColumn("goes", goes)
    own = lambda k: F.array(F.get("steps", k))
    none = F.slice("steps", 1, 0)
    moved = F.flatten(F.transform(every, lambda k: F.when(inside(k) | (k == F.col("goes")), none).when(k == onto, F.concat(own(k), part(node), F.array(blank(F.col("p"))))).otherwise(own(k))))
    # the nodes between the graft and the cut turn round: each keeps its other child and takes the one above as the second
    path = F.filter(F.sequence(onto + 1, node), lambda k: begin(k) <= onto)
    pairs = pairs.withColumn("path", F.when(F.col("upper"), path))
    child = lambda j: F.when(j == 0, onto).otherwise(F.get("path", F.greatest(j - 1, F.lit(0))))
    other = lambda k, j: F.when(child(j) == k - 1, k - 1 - size(k - 1)).otherwise(k - 1)
    blocks = F.transform("path", lambda k, j: F.concat(part(other(k, j)), F.when(k == node, none).otherwise(own(k))))
    turned = F.concat(F.slice("steps", F.lit(1), begin(node)), F.flatten(F.reverse(blocks)), part(onto), F.array(blank(node)), F.slice("steps", node + 2, F.size("steps")))
    made = cut(pairs.select(F.struct("tree", "node", "onto", "upper").alias("tree"), F.when(F.col("upper"), turned).otherwise(moved).alias("steps")))
    keys = topology_keys(made).select(F.col("tree.tree").alias("of"), "key", "tree")
    kept = keys.join(topology_keys(trees).withColumnRenamed("tree", "of"), ["of", "key"], "left_anti").groupBy("of", "key").agg(F.min("tree").alias("tree"))
    return made.join(kept.select("tree"), "tree", "left_semi").select("tree.tree", "tree.node", "tree.onto", "tree.upper", "steps")


def columns_of(patterns: DataFrame, taxa: list[str], weight: str = "weight", block: int = 1024) -> DataFrame:
    """name, block, masks, weights: the states of each taxon as bit masks, about ``block`` patterns a row.

    A null state is any state; one below 0 or above 62 raises.
    """
    checked = lambda x: F.when(F.col(x).isNull(), F.lit(-1).cast("long")).when(F.col(x).between(0, 62), F.expr(f"shiftleft(1L, cast(`{x}` as int))")).otherwise(F.raise_error(F.lit(f"a state of {x} is not between 0 and 62")).cast("long"))
    blocks = F.pmod(F.xxhash64(*taxa), F.ceil(F.lit(patterns.count()) / block).cast("long"))
    row = F.struct(*(checked(x).alias(f"m{k}") for k, x in enumerate(taxa)), F.col(weight).cast("long").alias("w"))
    held = patterns.select(blocks.alias("block"), row.alias("row")).groupBy("block").agg(F.collect_list("row").alias("rows"))
    stack = ", ".join(f"'{x}', rows.m{k}" for k, x in enumerate(taxa))
    return held.selectExpr("block", "rows.w as weights", f"stack({len(taxa)}, {stack}) as (name, masks)").select("name", "block", "masks", "weights")


def fitch_scores(trees: DataFrame, columns: DataFrame) -> DataFrame:
    """tree, score: the parsimony score of every tree on all patterns of ``columns_of``, in one plan.

    A tree's leaves meet the columns of their names, and the masks of a tree and a block run its program: children are
    taken in order, states in common stay, and where there are none the union stays and a change is counted. A tree of
    which a leaf is not among the columns has no score and no row. Without patterns there are no rows.
    """
    steps = F.filter("steps", lambda s: s["kids"] == 0)
    leaves = trees.select("tree", F.posexplode(F.transform(steps, lambda s: s["name"])).alias("leaf", "name"))
    met = leaves.join(columns, "name").groupBy("tree", "block").agg(F.array_sort(F.collect_list(F.struct("leaf", "masks"))).alias("held"), F.first("weights").alias("weights"))
    rows = met.join(trees.select("tree", "steps", F.size(steps).alias("leaves")), "tree").where(F.size("held") == F.col("leaves"))
    state = "struct<masks:array<bigint>,cost:bigint>"

    def together(acc: Column, kid: Column) -> Column:
        both = F.zip_with(acc["masks"], kid["masks"], lambda x, y: F.struct(x.bitwiseAND(y).alias("i"), x.bitwiseOR(y).alias("u")))
        bound = F.array(both)
        cost = F.transform(bound, lambda m: F.aggregate(F.zip_with(m, F.col("weights"), lambda b, w: F.when(b["i"] == 0, w).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x))[0]
        masks = F.transform(both, lambda b: F.when(b["i"] == 0, b["u"]).otherwise(b["i"]))
        return F.struct(masks.alias("masks"), (acc["cost"] + kid["cost"] + cost).alias("cost"))

    rows = rows.withColumn("run", F.transform("steps", lambda s: F.struct(s["kids"].alias("kids"))))
    # leaves take the masks in the order in which they come
    numbered = F.aggregate("run", F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<kids:int,leaf:int>>").alias("out")), lambda acc, s: F.struct((acc["n"] + (s["kids"] == 0).cast("int")).alias("n"), F.concat(acc["out"], F.array(F.struct(s["kids"].alias("kids"), acc["n"].alias("leaf")))).alias("out")), lambda acc: acc["out"])
    rows = rows.withColumn("run", numbered)
    leaf = lambda s: F.struct(F.col("held")[s["leaf"]]["masks"].alias("masks"), F.lit(0).cast("long").alias("cost"))
    inner = lambda kids, s: F.aggregate(F.slice(kids, F.lit(2), F.greatest(F.size(kids) - 1, F.lit(0))), kids[0], together)
    return rows.select("tree", folded(F.col("run"), leaf, inner, state)["cost"].alias("cost")).groupBy("tree").agg(F.sum("cost").alias("score"))


def climbed(trees: DataFrame, columns: DataFrame, rounds: int) -> DataFrame:
    """tree, steps, score, settled: each tree after at most ``rounds`` steps to its best neighbour, as long as that is better.

    All trees climb side by side: a round makes the neighbours of those that still move, leaves out by an anti-join those
    that the climb has seen, scores the others in one plan and keeps the least (ties to the first by branch and swap).
    ``settled`` says that no neighbour was better.
    """
    now = cut(trees.select("tree", "steps").join(fitch_scores(trees, columns), "tree").withColumn("settled", F.lit(False)))
    seen = cut(topology_keys(now))
    for _ in range(rounds):
        moving = now.where("not settled")
        if moving.isEmpty():
            break
        near = nni_neighbours(moving).withColumn("start", F.col("tree")).withColumn("tree", F.struct("start", "branch", "swap"))
        near = cut(near.select("tree", "start", "steps"))
        keys = topology_keys(near).select("tree", F.col("tree.start").alias("start"), "key")
        new = cut(keys.join(seen.select(F.col("tree").alias("start"), "key"), ["start", "key"], "left_anti").groupBy("start", "key").agg(F.min("tree").alias("tree")))
        fresh = near.join(new.select("tree"), "tree", "left_semi")
        best = fitch_scores(fresh, columns).groupBy(F.col("tree.start").alias("start")).agg(F.min(F.struct("score", "tree")).alias("best"))
        best = best.select("start", F.col("best.score").alias("least"), F.col("best.tree").alias("tree")).join(fresh.select("tree", F.col("steps").alias("to")), "tree").drop("tree")
        met = now.join(best.withColumnRenamed("start", "tree"), "tree", "left")
        better = F.coalesce(F.col("least") < F.col("score"), F.lit(False)) & ~F.col("settled")
        now = cut(met.select("tree", F.when(better, F.col("to")).otherwise(F.col("steps")).alias("steps"), F.when(better, F.col("least")).otherwise(F.col("score")).alias("score"), (~better).alias("settled")))
        seen = cut(seen.union(new.select(F.col("start").alias("tree"), "key")))
    return now
