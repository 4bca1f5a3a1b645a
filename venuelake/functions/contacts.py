"""Column functions over mail addresses, phone numbers and what a contact is for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes of mail addresses and mailboxes that are never a contact.
MAIL_SHAPE = r"^[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+$"
FILE_ENDINGS = r"\.(?:png|jpe?g|gif|webp|svg|css|js)$"
PLACEHOLDERS = r"(?:^|\.)(?:example\.(?:com|org|net)|sentry\.io|wixpress\.com|domain\.com|email\.com|yourdomain\.[a-z.]+|yoursite\.[a-z.]+|mysite\.com|website\.com|company\.com)$"
NO_CONTACT = r"^(?:no-?reply|do-?not-?reply|donotreply|mailer-daemon|postmaster|abuse|webmaster|hostmaster|privacy|dpo|gdpr|dataprotection|unsubscribe|bounce[s]?)$"
ROLE_MAILBOX = (
    r"^(?:info|hello|hi|contact|contactus|enquiries|enquiry|enquire|inquiries|inquiry|bookings?|book|events?|eventsteam|functions?|hire|venuehire|privatehire|venues?|office|boxoffice|tickets?|ticketsales|reception|reservations?"
    r"|hospitality|conference|conferences|conferencing|weddings?|sales|admin|manager|management|frontdesk|guests?|stay|marketing|press|technical|general|notes|groups?|meetings?|catering|restaurant|studio|team|mail|welcome)$"
)
#: Services of free mail, which say nothing of a site.
FREE_MAIL_DOMAINS = (
    "gmail.com googlemail.com outlook.com hotmail.com hotmail.co.uk live.com live.co.uk msn.com yahoo.com yahoo.co.uk ymail.com icloud.com me.com aol.com btinternet.com sky.com talktalk.net virginmedia.com gmx.com "
    "protonmail.com proton.me mweb.co.za telkomsa.net vodamail.co.za webmail.co.za iafrica.com absamail.co.za lantic.net polka.co.za afrihost.co.za cybersmart.co.za"
).split()
#: What a contact is for, the first that fits, and their order in a list.
PURPOSES = (
    ("CORPORATE_SUPPORT", r"\b(?:corporate|business) support\b"),
    ("ENQUIRIES", r"\b(?:special requests|larger groups|drop us a note|contact form)\b"),
    ("SALES_HIRE", r"\b(?:venue[- ]hire|private[- ](?:hire|events?|dining)|hire|functions?|sales|conference|corporate|weddings?|meetings?|events? (?:team|sales|office|enquir))\b|^(?:events|hire|sales|functions|weddings|conference)@"),
    ("BOOKINGS", r"\b(?:bookings?|reservations?|book (?:the|a|your|now))\b|^(?:bookings?|reservations?|book)@"),
    ("BOX_OFFICE", r"\bbox[- ]office\b|^(?:boxoffice|tickets)@"),
    ("SWITCHBOARD", r"\b(?:switchboard|main (?:line|office|number)|reception desk)\b"),
    ("ENQUIRIES", r"\benquir\w*|\binquir\w*|special requests|larger groups|all other enquiries|^(?:enquiries|inquiries)@"),
)
PURPOSE_ORDER = ("SALES_HIRE", "BOOKINGS", "ENQUIRIES", "CORPORATE_SUPPORT", "GENERAL", "SWITCHBOARD", "BOX_OFFICE", "FORM", "MESSAGING")
#: Labels that run into an address.
GLUED_LABELS = r"^(?:email|e-mail|enquiries|bookings?)$"
#: A mailbox in a text. One begins where no character of its kind is before it, or where the last one ended, so a long run of
#: such characters is read once, not once from each of them.
MAIL_IN_TEXT = r"(?i)(?:(?<![a-z0-9._%+-])|\G)[a-z0-9._%+-]++@[a-z0-9.-]+\.[a-z]{2,}"


def plain_mail(value: Column) -> Column:
    """Trimmed, in lower case, without a mailto: before and a query behind."""
    return F.split(F.regexp_replace(F.lower(F.trim(value)), "^mailto:", ""), r"\?")[0]


def mail_verdict(value: Column, third_party: Column | None = None) -> Column:
    """Why an address is no contact, or ACCEPTED. `third_party` says that its domain is a platform's."""
    mail = plain_mail(value)
    mailbox, domain = F.split(mail, "@")[0], F.split_part(mail, F.lit("@"), F.lit(2))
    return (
        F.when(~F.coalesce(mail.rlike(MAIL_SHAPE), F.lit(False)) | (F.length(mail) > 254) | domain.rlike(FILE_ENDINGS), "INVALID_EMAIL")
        .when(domain.rlike(PLACEHOLDERS), "PLATFORM_RELAY_OR_PLACEHOLDER").when(F.lit(False) if third_party is None else F.coalesce(third_party, F.lit(False)), "THIRD_PARTY_PLATFORM_DOMAIN")
        .when(mailbox.rlike(NO_CONTACT), "NON_CONTACT_MAILBOX").otherwise("ACCEPTED")
    )


def role_mailbox(value: Column) -> Column:
    return F.split(plain_mail(value), "@")[0].rlike(ROLE_MAILBOX)


def phone(raw: Column, host: Column) -> Column:
    """Digits with their country where it is told: after +, for 00, or, on a British host, for a national number of ten or
    eleven digits; other numbers stay as digits."""
    value = F.trim(F.regexp_replace(F.regexp_replace(raw, "(?i)^tel:", ""), r"\(0\)", ""))
    digits = F.regexp_replace(value, r"[^\d]", "")
    british = F.lower(host).endswith(".uk") & digits.startswith("0") & F.length(digits).between(10, 11)
    return (
        F.when(value.startswith("+"), F.concat(F.lit("+"), digits)).when(digits.startswith("00"), F.concat(F.lit("+"), F.substr(digits, F.lit(3))))
        .when(british, F.concat(F.lit("+44"), F.substr(digits, F.lit(2)))).otherwise(digits)
    )


def purpose(kind: Column, context: Column) -> Column:
    """What a contact is for, by its kind or the words around it."""
    text = F.lower(context)
    out = F.when(kind.isin("WHATSAPP", "BUSINESS_MESSAGING"), "MESSAGING").when(kind == "CONTACT_FORM", "FORM")
    for name, pattern in PURPOSES:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("GENERAL")


def purpose_rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PURPOSE_ORDER)), name) - 1


def before_mail(text: Column, mail: Column, span: int = 400) -> Column:
    """The address with up to `span` characters before it, none of them of a mailbox before it or further back; nothing where
    it does not occur."""
    at = F.position(F.lower(mail), F.lower(text))
    ahead = F.substr(text, F.lit(1), at - 1)
    others = F.regexp_extract_all(ahead, F.lit(MAIL_IN_TEXT), 0)
    # the last mailbox before it: what follows its last occurrence
    rest = F.when(F.size(others) > 0, F.call_function("substring_index", ahead, F.element_at(F.array_insert(others, 1, F.lit("")), -1), F.lit(-1))).otherwise(ahead)
    return F.when(at > 0, F.concat(F.right(rest, F.lit(span)), F.substr(text, at, F.length(mail)))).otherwise("")


def decoded_mail(code: Column) -> Column:
    """An address hidden as hex: each byte after the first is XORed with it; null unless the result has an @. The bytes are
    read at once, as the characters of those codes, and the text is made once."""
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    plain = F.decode(F.unhex(F.left(code, F.length(code) - F.length(code) % 2)), "ISO-8859-1")
    shown = lambda c: F.array_join(F.transform(F.slice(c, 2, F.size(c)), lambda x: F.char(F.ascii(x).bitwiseXOR(F.ascii(F.get(c, F.lit(0)))))), "")
    return F.when(code.rlike("^(?:[0-9a-f]{2}){4,}$"), once(once(F.split(plain, ""), shown), lambda t: F.when(F.contains(t, F.lit("@")), t)))
