"""Text keys and normal forms as columns."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _single(change) -> tuple[str, str]:
    """The characters of the basic plane that `change` turns into one other character, and those. Lower-casing comes first."""
    pairs = [(c, d) for c in map(chr, [*range(0x80, 0xAC00), *range(0xF900, 0xFFFE)]) if len(d := change(c)) == 1 and d != c.lower() and c == c.lower()]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def _several(change) -> list[tuple[str, str]]:
    """Letters that `change` turns into several characters."""
    return [(c, d) for c in "ßŉǰΐΰևẖẗẘẙẚﬀﬁﬂﬃﬄﬅﬆ" if len(d := change(c)) > 1]


def _bare(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x))


_CASELESS, _FOLDED = _single(str.casefold), _single(_bare)
_CASELESS_LONG, _FOLDED_LONG = _several(str.casefold), _several(_bare)
_MARKS = r"[\u0300-\u036f]"


def _changed(text: Column, single: tuple[str, str], several: list[tuple[str, str]]) -> Column:
    """Characters that aren't ASCII are replaced by tables that come from Unicode's data; plain texts aren't touched."""
    out = F.translate(text, *single)
    for c, d in several:
        out = F.replace(out, F.lit(c), F.lit(d))
    return out


def casefold(text: Column) -> Column:
    """Caseless form: lower case, then what Unicode folds further (sharp s, final sigma, ligatures). Greek letters with marks that
    it takes apart stay whole, in every text alike."""
    low = F.lower(text)
    return F.when(low.rlike(r"[^\x00-\x7f]"), _changed(low, _CASELESS, _CASELESS_LONG)).otherwise(low)


def fold(text: Column) -> Column:
    """Caseless and without accents, in any script of the basic plane; composed and decomposed letters alike."""
    low = F.lower(text)
    return F.when(low.rlike(r"[^\x00-\x7f]"), F.regexp_replace(_changed(low, _FOLDED, _FOLDED_LONG), _MARKS, "")).otherwise(low)


def without_accents(text: Column) -> Column:
    """Letters lose their accents and keep their case."""
    both = lambda low, bare: (low + low.upper(), bare + bare.upper())
    kept = [(c, d) for c, d in zip(*_FOLDED, strict=True) if len(c.upper()) == 1 == len(d.upper())]
    return F.regexp_replace(F.translate(text, *both("".join(c for c, _ in kept), "".join(d for _, d in kept))), _MARKS, "")


def words(text: Column) -> Column:
    """The folded words (letters and digits) of a text, in order."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def normalize_email(text: Column) -> Column:
    return F.lower(F.trim(text))


def phone_key(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def host_key(url: Column) -> Column:
    """A host's comparable form: no scheme, user, port, www. or final dot; lower case, international names in their ASCII form."""
    rest = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@", "")
    return F.regexp_replace(ascii_host(F.regexp_replace(F.regexp_replace(host, r":\d*$", ""), r"\.$", "")), r"^www\.", "")


def url_key(url: Column) -> Column:
    """host_key and path without fragment and final slash; a bare host stays a host."""
    rest = F.regexp_replace(F.trim(url), r"(?i)^[a-z][a-z0-9+.\-]*://", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*(.*)$", 1), "#.*$", ""), "/+$", "")
    return F.concat(host_key(url), path)


def ascii_host(host: Column) -> Column:
    """International host names in their ASCII form, by the JVM's own routine; names that have none stay as they are."""
    return F.when(host.rlike(r"[^\x00-\x7f]"), F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host), host)).otherwise(host)


def kebab(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1-$2")), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def humanize(text: Column) -> Column:
    spaced = F.lower(F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, F.lit(2), F.length(spaced)))


def header_key(text: Column) -> Column:
    """A column header's comparable form: folded letters and digits only."""
    return F.array_join(words(text), "")


def single_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\p{Cc}]+", " "))


def split_name(text: Column) -> Column:
    """(firstName, lastName): around a comma, else the last word is the last name."""
    t = single_line(text)
    comma = t.contains(",")
    before, after = F.trim(F.substring_index(t, ",", 1)), F.trim(F.regexp_replace(t, "^[^,]*,", ""))
    last = F.substring_index(t, " ", -1)
    first = F.trim(F.substring(t, F.lit(1), F.greatest(F.lit(0), F.length(t) - F.length(last))))
    return F.struct(F.when(comma, after).otherwise(F.nullif(first, F.lit(""))).alias("firstName"), F.when(comma, before).otherwise(last).alias("lastName"))


#: Reply and forward marks before a subject.
SUBJECT_MARKS = ["re", "aw", "antw", "antwort", "fw", "fwd", "wg", "wtr", "sv", "vs", "rif", "r", "tr", "enc", "res", "odp", "vb", "doorst", "ynt", "vl"]
_marks = r"^\s*(?:(?:" + "|".join(SUBJECT_MARKS) + r")\s*(?:\[\d+\]|\(\d+\))?\s*:\s*)+"


def subject_key(subject: Column) -> Column:
    """A subject without reply and forward marks, in lower case, with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(subject), _marks, ""), r"\s+", " "))


def thread_root(references: Column, in_reply_to: Column, message_id: Column, fallback: Column) -> Column:
    """The message that a thread starts with: first reference, else the one replied to, else itself."""
    first = lambda ids: F.when(F.size(ids) > 0, F.get(ids, F.lit(0)))
    return F.coalesce(first(references), first(in_reply_to), F.nullif(message_id, F.lit("")), F.sha2(fallback, 256))


#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = """
co.uk org.uk ac.uk gov.uk me.uk ltd.uk plc.uk net.uk sch.uk nhs.uk police.uk com.au net.au org.au edu.au gov.au asn.au id.au co.nz org.nz net.nz ac.nz govt.nz school.nz co.jp ne.jp or.jp ac.jp go.jp ad.jp ed.jp gr.jp
lg.jp co.kr or.kr ne.kr go.kr ac.kr re.kr com.br net.br org.br gov.br edu.br art.br com.cn net.cn org.cn gov.cn edu.cn ac.cn com.hk org.hk net.hk edu.hk gov.hk idv.hk com.tw org.tw net.tw edu.tw gov.tw idv.tw com.sg
org.sg net.sg edu.sg gov.sg per.sg com.my org.my net.my edu.my gov.my co.in net.in org.in firm.in gen.in ind.in ac.in edu.in gov.in res.in co.za org.za net.za gov.za ac.za web.za co.il org.il net.il ac.il gov.il muni.il
com.mx org.mx net.mx gob.mx edu.mx com.ar org.ar net.ar gob.ar edu.ar com.tr org.tr net.tr gen.tr edu.tr gov.tr biz.tr com.pl net.pl org.pl edu.pl gov.pl co.at or.at ac.at gv.at com.es org.es nom.es edu.es gob.es com.pt
org.pt edu.pt gov.pt co.id or.id ac.id go.id web.id com.ph net.ph org.ph gov.ph edu.ph co.th ac.th go.th or.th in.th com.vn net.vn org.vn edu.vn gov.vn com.ua org.ua net.ua gov.ua edu.ua co.ke or.ke ac.ke go.ke com.ng
org.ng gov.ng edu.ng com.eg edu.eg gov.eg com.sa edu.sa gov.sa com.pk org.pk edu.pk gov.pk com.co org.co edu.co gov.co com.pe org.pe edu.pe gob.pe com.uy edu.uy gub.uy co.ma co.cr co.ve com.ve
""".split()
#: Our own list of hosts that give mail accounts to anyone.
FREE_MAIL = "gmail.com googlemail.com outlook.com hotmail.com live.com yahoo.com gmx.de gmx.net web.de icloud.com aol.com proton.me protonmail.com mail.com t-online.de".split()


def registrable_domain(host: Column) -> Column:
    """The last two labels of a host, or three below a second-level suffix; '' for such a suffix itself, a number stays."""
    h = F.regexp_replace(F.lower(host), r"^\.+|\.+$", "")
    short = F.substring_index(h, ".", -2)
    return F.when(h.rlike(r"^[\d.]+$"), h).when(h.isin(TWO_LABEL_SUFFIXES), "").when(short.isin(TWO_LABEL_SUFFIXES), F.substring_index(h, ".", -3)).otherwise(short)


def company_from_domain(host: Column) -> Column:
    """The label that is registered, its first letter a capital."""
    label = F.substring_index(registrable_domain(host), ".", 1)
    return F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, F.lit(2), F.length(label)))


def email_host(address: Column) -> Column:
    return F.substring_index(normalize_email(address), "@", -1)


def is_free_mail(address: Column) -> Column:
    return email_host(address).isin(FREE_MAIL)


#: What stands anywhere in an address of a machine, and before the @ of a group's.
MACHINE_MARKS = ["noreply", "no-reply", "do_not_reply", "no.reply"]
GROUP_STARTS = ["info@", "contact@", "hello@", "support@", "feedback@", "service@", "help@", "invites@", "invite@", "welcome@", "alerts@", "team@", "notifications@", "notification@", "news@"]


def is_group_address(address: Column) -> Column:
    a = normalize_email(address)
    return reduce(or_, [a.contains(m) for m in MACHINE_MARKS] + [a.startswith(m) for m in GROUP_STARTS])


def person_name(display: Column, address: Column) -> Column:
    """(firstName, lastName) of a correspondent, at most 100 characters each.

    A display name that is no address counts first: `Family, Given`, or words of which the first is the given name. Written with dots, the first
    word holds further names, unless the words behind it repeat them. Quotes around the name, a plus tag within the first word and a
    colon tag at the end of a name are no part of it. A name that the display lacks comes from the address, by its dots. The first letter is a capital.
    """
    dotted = lambda word: F.filter(F.split(F.substring_index(word, "+", 1), r"\."), lambda p: p != "")
    after_first = lambda names: F.array_join(F.slice(names, 2, F.greatest(F.size(names), F.lit(1))), " ")
    mailbox = dotted(F.regexp_replace(address, "@[^@]*$", ""))
    name = F.trim(F.regexp_replace(single_line(F.coalesce(display, F.lit(""))), "^['\"]+|['\"]+$", ""))
    name = F.when(name.contains("@"), "").otherwise(name)

    sides = F.transform(F.split(name, ",", 2), lambda s: F.trim(s))
    by_comma = (F.size(sides) == 2) & (sides[0] != "") & (F.regexp_replace(F.get(sides, F.lit(1)), r"[,\s]", "") != "")
    given_behind = single_line(F.replace(F.get(sides, F.lit(1)), F.lit(","), F.lit(" ")))

    words = F.split(name, " ")
    opening, following = dotted(words[0]), after_first(words)
    also = after_first(opening)
    family = F.when(F.lower(following).startswith(F.lower(also)), following).otherwise(F.trim(F.concat_ws(" ", also, following)))

    def shown(part: Column, instead: Column) -> Column:
        bare = F.trim(F.regexp_replace(F.coalesce(part, F.lit("")), r":[^:]+$", ""))
        text = single_line(F.coalesce(F.nullif(bare, F.lit("")), instead, F.lit("")))
        return F.substring(F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.lit(100))), 1, 100)

    first = shown(F.when(by_comma, given_behind).otherwise(F.get(opening, F.lit(0))), F.get(mailbox, F.lit(0)))
    return F.struct(first.alias("firstName"), shown(F.when(by_comma, sides[0]).otherwise(family), after_first(mailbox)).alias("lastName"))


def is_blocklisted(address: Column, entries: Column) -> Column:
    """Whether an address equals an entry of an array, or its host is an entry or below one."""
    a, host = normalize_email(address), email_host(address)
    bare = lambda e: F.regexp_replace(F.lower(F.trim(e)), "^@", "")
    return F.exists(entries, lambda e: (a == F.lower(F.trim(e))) | (host == bare(e)) | host.endswith(F.concat(F.lit("."), bare(e))))


def guarded(cell: Column) -> Column:
    """A cell that a spreadsheet won't run as a formula."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]") & ~cell.rlike(r"^[+\-]?[0-9][0-9.,]*$"), F.concat(F.lit("'"), cell)).otherwise(cell)


def unguarded(cell: Column) -> Column:
    return F.when(cell.rlike(r"^'[=+\-@\t\r]"), F.substring(cell, 2, 1 << 30)).otherwise(cell)


#: Own patterns for credentials: (kind, pattern).
SECRETS = [
    ("private-key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)"),
    ("json-web-token", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
    ("url-credentials", r"(?<=://)[^\s/:@]+:[^\s/@]+(?=@)"),
    ("access-key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("credential-phrase", r"""(?i)\b(?:password|passwd|passwort|secret|token|api[_-]?key)\b\s*[:=]\s*["']?[^\s"']{6,}["']?"""),
]


def redact(text: Column) -> Column:
    """A text with credentials replaced by [redacted:kind]."""
    for kind, pattern in SECRETS:
        text = F.regexp_replace(text, pattern, f"[redacted:{kind}]")
    return text


#: Own list of labels behind which a secret stands, on the same line or alone on one of the next two.
SECRET_LABELS = ["password", "passwort", "kennwort", "passcode", "kenncode", "passphrase", "secret", "pin", "tan", "api key", "access token", "zugangscode", "mot de passe", "contraseña"]
#: Own list of names of URL parameters that carry secrets.
SECRET_PARAMETERS = ["token", "access_token", "id_token", "auth", "pwd", "password", "pass", "code", "key", "api_key", "apikey", "sig", "signature", "secret"]
_labels = "(?:" + "|".join(x.replace(" ", "[ _-]?") for x in SECRET_LABELS) + ")"


def redact_lines(text: Column) -> Column:
    """A text whose secrets behind labels are replaced: `label: value` at the end of a line, or a single word of up to 128 characters
    alone on the line after its label, an empty line between them allowed. Each line looks back on two, so the text is read once."""
    mark = "[redacted:credential-line]"
    heading = lambda line: line.rlike(rf"(?iu)^[ \t]*(?:[^:\n]{{0,40}}[ \t(])?{_labels}[ \t]*\)?[ \t]*:[ \t\r]*$")
    blank = lambda line: line.rlike(r"^\s*$")

    def passed(lines: Column) -> Column:
        def one(line: Column, k: Column) -> Column:
            first, second = F.get(lines, k - 1), F.get(lines, k - 2)
            behind = (k > 0) & heading(first) | (k > 1) & blank(first) & heading(second)
            alone = line.rlike(r"^\s*\S{1,128}\s*$") & ~line.contains("[redacted:")
            said = F.regexp_replace(line, rf"(?iu)((?:^|[ \t(]){_labels}[ \t]*\)?[ \t]*:[ \t]*)(?!\[redacted:)\S{{3,128}}(?=[ \t\r]*$)", "$1" + mark)
            return F.when(behind & alone, F.regexp_replace(line, r"\S+", mark)).otherwise(said)

        return F.transform(lines, one)

    # Bound once, as each line looks at its neighbours.
    return F.array_join(F.get(F.transform(F.array(F.split(text, "\n")), passed), F.lit(0)), "\n")


def redact_parameters(text: Column) -> Column:
    """A text whose URLs have no value in parameters that are named like secrets."""
    return F.regexp_replace(text, r"(?i)([?&;](?:" + "|".join(SECRET_PARAMETERS) + r")=)(?!\[redacted:)[^&;#\s\"'<>\])]+", "$1[redacted:url-parameter]")


def redact_all(text: Column) -> Column:
    """Credentials by their shapes, in URLs, and by the labels before them, on the same line or alone on a later one."""
    for kind, pattern in SECRETS:
        if kind != "credential-phrase":
            text = F.regexp_replace(text, pattern, f"[redacted:{kind}]")
    within = dict(SECRETS)["credential-phrase"].replace(r"\s*[:=]\s*", r"[ \t]*[:=][ \t]*").replace("""["']?[^""", r"""["']?(?!\[redacted:)[^""", 1)
    return F.regexp_replace(redact_lines(redact_parameters(text)), within, "[redacted:credential-phrase]")


def is_unsubscribe_address(address: Column) -> Column:
    """Whether an address only takes cancellations: by a word of its local part, or of a label below its registered domain."""
    a = normalize_email(address)
    word = r"(?<![a-z])(?:unsubscribe|unsub|opt[.\-_]?out)(?![a-z])"
    local, host = F.regexp_replace(a, "@[^@]*$", ""), email_host(a)
    domain = registrable_domain(host)
    below = F.when((domain != "") & (host != domain), F.substring(host, F.lit(1), F.length(host) - F.length(domain) - 1)).otherwise("")
    return local.rlike(word) | F.exists(F.split(below, r"\."), lambda label: label.rlike(word))


def secret_kinds(text: Column) -> Column:
    """The kinds of credentials that a text holds."""
    return F.filter(F.array(*(F.when(text.rlike(p), F.lit(k)) for k, p in SECRETS)), lambda k: k.isNotNull())


def portable_reference(text: Column) -> Column:
    """Whether a path is relative, stays below its folder and names no drive or scheme."""
    return ~text.rlike(r"^/|^[A-Za-z]:|^[a-z]+://|\\") & ~text.rlike(r"(^|/)\.\.(/|$)") & (F.length(text) > 0)


_template = re.compile(r"\{\{\s*([\w.\[\]]+)\s*\}\}")


def filled(template: str, columns: dict[str, Column]) -> Column:
    """A text template with {{name}} places filled from columns; unknown names become empty."""
    parts, at = [], 0
    for m in _template.finditer(template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(columns.get(m[1], F.lit(None)).cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))
