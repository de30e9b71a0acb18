"""Errors that planning raises, always on the driver and before any job starts."""


class ProfileError(ValueError):
    """A profile, or something it names, cannot be used."""


class ProfileCompileError(ProfileError):
    """A pattern of the profile cannot be turned into a rule."""


class UnknownDialectError(ProfileError):
    """The profile names a spelling dialect that does not exist."""


class UnknownPresetError(ProfileError):
    """A preset pack was asked for that does not exist."""
