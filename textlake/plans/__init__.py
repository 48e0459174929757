"""textlake.plans"""
