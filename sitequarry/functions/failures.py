"""Failures as columns: kind, status and message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hints added to a failed API call, by status.
STATUS_HINTS = {
    404: "Check if the WordPress REST API is enabled on this site.",
    403: "The API endpoint may be protected. Try checking site permissions.",
    500: "Server error. The site may be experiencing issues. Try again later.",
    401: "Authentication required. This endpoint may need credentials.",
}

# Wording of the messages.
_HINT = "\n  Suggestion: "
BAD_DOMAIN = "Invalid domain '"
DOMAIN_ADVICE = ". Please provide a valid domain name (e.g., 'example.com' or 'www.example.com')."
API_FAILED = "WordPress API error for "
API_DEFAULT = "API request failed"
SSL_FAILED = "SSL verification failed for "
SSL_ADVICE = "If you trust this site, certificate verification can be turned off (not recommended for production)."
DOWNLOAD_FAILED = "Failed to download "
DOWNLOAD_ADVICE = "Check your internet connection and verify the URL is accessible."
MEDIA_MISSING = "Media file not found: "
MEDIA_ADVICE = "Run the dump first to generate the media file list."
CHECKPOINT_FAILED = "Checkpoint error: "


def is_http_error(status: Column) -> Column:
    return (status >= 400) & (status < 600)


def is_success(status: Column, error: Column) -> Column:
    """A response came back and its status is no client or server error."""
    return F.coalesce(error.isNull() & status.isNotNull() & ~is_http_error(status), F.lit(False))


def status_class(status: Column) -> Column:
    return F.when(status.isin(401, 403), "protected").when(status == 200, "ok").otherwise("unknown")


def failure_kind(status: Column, error: Column) -> Column:
    """ssl for an error text that begins with SSL or TLS, api for all other failures, else NULL."""
    return F.when(error.rlike("(?i)^(ssl|tls)"), "ssl").when(
        error.isNotNull() | status.isNull() | is_http_error(status), "api"
    )


def domain_message(domain: Column, reason: Column) -> Column:
    return F.concat(F.lit(BAD_DOMAIN), domain, F.lit("': "), reason, F.lit(DOMAIN_ADVICE))


def api_message(url: Column, status: Column, detail: Column) -> Column:
    hint = F.lit("")
    for code, text in STATUS_HINTS.items():
        hint = F.when(status == code, _HINT + text).otherwise(hint)
    return F.concat(
        F.lit(API_FAILED),
        url,
        F.when(F.coalesce(status, F.lit(0)) != 0, F.concat(F.lit(" (HTTP "), status.cast("string"), F.lit(")"))).otherwise(""),
        F.lit(": "),
        F.coalesce(detail, F.lit(API_DEFAULT)),
        hint,
    )


def _with_reason(start: str, subject: Column, reason: Column, hint: str) -> Column:
    return F.concat(
        F.lit(start),
        subject,
        F.when(F.coalesce(reason, F.lit("")) != "", F.concat(F.lit(": "), reason)).otherwise(""),
        F.lit(_HINT + hint),
    )


def ssl_message(url: Column, reason: Column) -> Column:
    return _with_reason(SSL_FAILED, url, reason, SSL_ADVICE)


def download_message(url: Column, reason: Column) -> Column:
    return _with_reason(DOWNLOAD_FAILED, url, reason, DOWNLOAD_ADVICE)


def media_missing_message(path: Column) -> Column:
    return _with_reason(MEDIA_MISSING, path, F.lit(""), MEDIA_ADVICE)


def checkpoint_message(detail: Column) -> Column:
    return F.concat(F.lit(CHECKPOINT_FAILED), detail)
