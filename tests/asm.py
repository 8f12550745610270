"""Writes disassembly text for tests from short descriptions."""


def method(cls, name, code, sig="()V", access=0x1, registers=8, ins=1, catches=(), lines=True):
    """code: a list of instructions; a tuple (label, text) marks a place that operands name as @label."""
    places, plain = {}, []
    for i, x in enumerate(code):
        if isinstance(x, tuple):
            places[x[0]] = i
            x = x[1]
        plain.append(x)
    for label, at in places.items():
        plain = [x.replace(f"@{label}", f"{at:04x}") for x in plain]
    out = [f"    #0              : (in L{cls.replace('.', '/')};)", f"      name          : '{name}'", f"      type          : '{sig}'", f"      access        : 0x{access:04x} (X)", "      code          -", f"      registers     : {registers}", f"      ins           : {ins}"]
    out.append(f"000148:                                        |[000148] {cls}.{name}:{sig}")
    out += [f"000158: 0000 0000                              |{i:04x}: {x}" for i, x in enumerate(plain)]
    out.append(f"      catches       : {len(catches)}")
    for lo, hi, handler in catches:
        out += [f"        0x{places.get(lo, lo):04x} - 0x{places.get(hi, hi):04x}", f"          <any> -> 0x{places.get(handler, handler):04x}"]
    out.append("      positions     :")
    out += [f"        0x{i:04x} line={10 + i}" for i in range(len(plain))] if lines else []
    out.append("      locals        :")
    return out


def clazz(name, methods, sup="java.lang.Object", interfaces=(), fields=()):
    desc = lambda n: f"L{n.replace('.', '/')};"
    out = ["Class #0            -", f"  Class descriptor  : '{desc(name)}'", "  Access flags      : 0x0001 (PUBLIC)", f"  Superclass        : '{desc(sup)}'", "  Interfaces        -"]
    out += [f"    #{i}              : '{desc(x)}'" for i, x in enumerate(interfaces)]
    out.append("  Instance fields   -")
    for f, access in fields:
        out += [f"    #0              : (in {desc(name)})", f"      name          : '{f}'", "      type          : 'Ljava/lang/Object;'", f"      access        : 0x{access:04x} (X)"]
    out.append("  Direct methods    -")
    for m in methods:
        out += m
    return [*out, f"  source_file_idx   : 1 ({name.rsplit('.', 1)[-1].split('$')[0]}.java)", ""]


def sync(reg, body):
    return [f"monitor-enter v{reg}", *body, f"monitor-exit v{reg}"]


def field(reg, cls, name, static=True, base=7):
    d = f"L{cls.replace('.', '/')};.{name}:Ljava/lang/Object; // field@0001"
    return f"sget-object v{reg}, {d}" if static else f"iget-object v{reg}, v{base}, {d}"


def put(src, base, cls, name):
    return f"iput v{src}, v{base}, L{cls.replace('.', '/')};.{name}:I // field@0002"


def call(kind, regs, cls, name, sig="()V"):
    return f"invoke-{kind} {{{', '.join(f'v{r}' for r in regs)}}}, L{cls.replace('.', '/')};.{name}:{sig} // method@0003"


def nested(cls, *names, inner=("nop",)):
    """Statics taken one inside the other."""
    code = list(inner)
    for i in range(len(names) - 1, -1, -1):
        code = [field(i, cls, names[i]), *sync(i, code)]
    return [*code, "return-void"]
