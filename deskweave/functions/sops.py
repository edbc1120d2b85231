"""Default procedure library and the column that picks a procedure."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .defaults import Sop

# Procedures per intent, in rank order; {product} is the product's name.
_SOPS = (
    Sop("playback_issue", "PB_01_BASIC_REFRESH", "Session Refresh & Device Restart",
        ("song skipping", "playback stuttering", "pauses unexpectedly", "music stops", "won't play", "skip"),
        ("1. Log out of your {product} account.",
         "2. Fully close the {product} app and restart your device.",
         "3. Log back in and test playback.")),
    Sop("playback_issue", "PB_02_NETWORK_STREAMING", "Network & Audio Streaming Quality Toggle",
        ("buffering", "lag", "intermittent pauses", "slow streaming", "wifi cellular"),
        ("1. Test switching between Wi-Fi and mobile data (or restart your home Wi-Fi router).",
         "2. In {product} Settings > Audio Quality, lower the streaming quality to Normal to prevent buffer underruns.",
         "3. If on desktop, toggle 'Hardware Acceleration' in {product} Settings > Show Advanced Settings.")),
    Sop("playback_issue", "PB_03_CONTENT_LICENSING", "Greyed-out Track & Regional Availability",
        ("greyed out", "song unplayable", "this song is not available", "broken album", "song missing"),
        ("1. Confirm if the track appears greyed out; content availability is determined by rights-holders and varies by region.",
         "2. In Settings > Playback, ensure 'Show unplayable songs' is enabled to verify status.",
         "3. Log out and back in to refresh local music licensing catalog tokens.")),
    Sop("playback_issue", "PB_04_CLEAN_REINSTALL_PLAYBACK", "Corrupted Audio Cache Clean Reinstall",
        ("songs crash repeatedly", "playback frozen permanently", "audio distorted"),
        ("1. Uninstall the {product} app from your device.",
         "2. Delete local cached app files to ensure corrupted audio streams are cleared.",
         "3. Reinstall the latest version of {product} from your device's app store.")),
    Sop("app_technical", "TECH_01_CLEAN_REINSTALL", "Standard Clean Reinstallation Protocol",
        ("app crash on launch", "black screen", "blank screen", "won't open", "freezes", "crash on startup", "crash"),
        ("1. Uninstall the {product} app from your device.",
         "2. Manually delete residual cache files (Windows: %appdata%\\{product}; Mac: ~/Library/Application Support/{product}; Mobile: clear app storage).",
         "3. Restart the device.",
         "4. Reinstall a fresh copy from your device's official app store.")),
    Sop("app_technical", "TECH_02_CLEAR_CACHE", "Application Storage & Cache Wipe",
        ("app slow", "lagging", "high storage", "local files glitched", "clear cache"),
        ("1. Open {product} and navigate to Settings > Storage.",
         "2. Tap 'Clear cache' (this will not delete downloaded offline playlists, but refreshes temporary index files).",
         "3. Restart the app.")),
    Sop("app_technical", "TECH_03_WEB_PLAYER", "Web Player Browser Isolation",
        ("web player crash", "web player won't load", "chrome web player", "browser frozen", "firefox"),
        ("1. Test the web player in a Private / Incognito browser window to bypass extension conflicts.",
         "2. Clear your browser's cached images and cookies.",
         "3. Ensure your browser's Protected Content / Widevine DRM playback setting is enabled.")),
    Sop("app_technical", "TECH_04_DLL_RUNTIME", "Windows Runtime / Corrupted Installer Repair",
        ("dll missing", "api-ms-win", "error code", "installer error", "vcruntime"),
        ("1. Download the full standalone offline installer directly rather than using app store mirrors.",
         "2. Update pending Microsoft Visual C++ redistributable packages on Windows.",
         "3. Run the installer as Administrator.")),
    Sop("account_login", "AUTH_01_PASSWORD_RESET", "Standard Self-Service Password Reset",
        ("forgot password", "can't log in", "invalid password", "wrong password", "reset link"),
        ("1. Access the official password reset tool on the {product} website using your registered email or username.",
         "2. Check your email inbox (including Spam/Junk folders) and follow the password reset link.",
         "3. If using Facebook login, verify your Facebook credentials or set an explicit device password.")),
    Sop("account_login", "AUTH_02_14_DAY_TRAVEL", "14-Day Free Tier Overseas Travel Policy",
        ("14 days abroad", "14 days overseas", "blocked abroad", "country mismatch login", "travelling"),
        ("1. Free {product} accounts can only be used outside your registered home country for 14 days.",
         "2. To continue using Free abroad: log into your account overview on a web browser and update your country setting in Profile.",
         "3. Note: Premium accounts do not have the 14-day travel restriction and work worldwide.")),
    Sop("account_login", "AUTH_03_OFFLINE_LOCKOUT", "Offline Mode Authentication Renewal",
        ("logged out in offline mode", "can't log in offline", "offline mode lockout"),
        ("1. Connect your device to an active Wi-Fi or cellular network.",
         "2. Launch the app and log in while connected to refresh authentication security tokens.",
         "3. Once logged in, you can safely re-enable Offline Mode in Settings > Playback.")),
    Sop("device_platform", "DEV_01_POWER_CYCLE_CONNECT", "Console & Smart TV Power Cycle / {product} Connect",
        ("ps4", "ps5", "playstation", "xbox", "tv", "smart tv", "{product_lower} connect", "roku"),
        ("1. Completely power down the console or TV for 30–60 seconds (unplug power cable from wall).",
         "2. Verify that your phone/computer and your console/TV are connected to the exact same Wi-Fi network name/band.",
         "3. Open {product} on your mobile app and select Devices Available ({product} Connect) to pair.")),
    Sop("device_platform", "DEV_02_BLUETOOTH_PAIRING", "Bluetooth & Speaker Re-pairing Protocol",
        ("bluetooth", "speaker", "car bluetooth", "headphones", "audio disconnect"),
        ("1. In your device Settings > Bluetooth, 'Forget' or remove the speaker/headphones.",
         "2. Turn off Bluetooth on your device, restart the device, and turn Bluetooth back on.",
         "3. Put your speaker/headphones into pairing mode and re-pair.")),
    Sop("device_platform", "DEV_03_CAR_INTEGRATION", "CarPlay & Android Auto Connection Refresh",
        ("carplay", "android auto", "car audio", "car display", "head unit"),
        ("1. Disconnect and re-connect the USB cable (or re-pair Bluetooth connection).",
         "2. Check phone settings to ensure CarPlay / Android Auto permissions are enabled for {product}.",
         "3. Restart both the phone and your car's infotainment head unit.")),
    Sop("premium_billing", "BILL_01_FAMILY_INVITE", "Family & Duo Plan Invitation / Address Match",
        ("family plan invite", "can't add family member", "error 3", "invite link", "duo plan"),
        ("1. The plan manager must generate a new invite link from their account page.",
         "2. The invited family member should open the link in a Private/Incognito browser window.",
         "3. Crucial: The invitee must enter the exact same residential home address as the plan manager.")),
    Sop("premium_billing", "BILL_02_STUDENT_DISCOUNT", "Student Discount Verification & Renewal",
        ("student discount", "sheerid", "student verification", "college discount"),
        ("1. Log into the student discount portal via the {product} website on a web browser.",
         "2. Complete student enrollment verification through SheerID.",
         "3. Note: Student discount must be renewed every 12 months (up to a maximum of 4 years).")),
    Sop("premium_billing", "BILL_03_CANCELLATION_DOWNGRADE", "Subscription Cancellation & Cycle Expiration",
        ("cancel subscription", "stop premium", "how to cancel", "downgrade to free"),
        ("1. Log into your account page on a web browser and select 'Change plan' > 'Cancel Premium'.",
         "2. Note: Your Premium features will remain active until your current paid billing cycle ends.",
         "3. After the cycle ends, your account automatically reverts to Free with all playlists preserved.")),
)


def default_sops(product: str) -> tuple[Sop, ...]:
    """The procedure library with the product's name filled in."""

    def fill(text: str) -> str:
        return text.replace("{product_lower}", product.lower()).replace("{product}", product)

    return tuple(
        Sop(s.intent, s.sop_id, fill(s.name), tuple(map(fill, s.triggers)), tuple(map(fill, s.steps))) for s in _SOPS
    )


_SOP_ITEMS = "array<struct<sop_id: string, name: string, steps: array<string>>>"


def match_sop(intent: Column, lowered: Column, sops: Sequence[Sop]) -> Column:
    """First procedure of the intent with a trigger inside the lower-case text.

    Falls back to the intent's first procedure; null for an intent without any.
    Triggers are plain substrings, as the procedure authors expect.  Only a
    position is computed per row; the records are one constant array.
    """
    by_intent: dict[str, list[int]] = {}
    for position, sop in enumerate(sops, start=1):
        by_intent.setdefault(sop.intent, []).append(position)
    per_intent = []
    for name, positions in by_intent.items():
        chosen = F.lit(positions[0])
        for position in reversed(positions):
            if sops[position - 1].triggers:
                chosen = F.when(_any_trigger(lowered, sops[position - 1].triggers), F.lit(position)).otherwise(chosen)
        per_intent.append(F.when(intent == name, chosen))
    records = json.dumps([{"sop_id": s.sop_id, "name": s.name, "steps": list(s.steps)} for s in sops])
    return F.try_element_at(F.from_json(F.lit(records), _SOP_ITEMS), F.coalesce(*per_intent))


def _any_trigger(lowered: Column, triggers: Sequence[str]) -> Column:
    found = lowered.contains(triggers[0])
    for trigger in triggers[1:]:
        found = found | lowered.contains(trigger)
    return F.coalesce(found, F.lit(False))
