"""Names that detectors leave alone."""

# Packages of good reputation, and the most looked-for names.
REPUTABLE = [
    "react", "react-dom", "vue", "angular", "next", "nuxt", "express", "fastify", "hono", "koa", "connect", "webpack", "vite", "rollup", "esbuild", "typescript", "babel-core",
    "lodash", "ramda", "underscore", "axios", "node-fetch", "got", "superagent", "sequelize", "prisma", "typeorm", "mongoose", "jest", "mocha", "vitest", "ava", "prettier", "eslint",
    "stylelint", "socket.io", "ws", "rimraf", "glob", "minimatch", "fs-extra", "electron", "puppeteer", "playwright", "sharp", "node-canvas", "ffmpeg-static", "turbo", "react-scripts",
    "@angular/cli", "gatsby", "parcel", "tslib", "core-js", "regenerator-runtime", "buffer", "node-gyp", "node-pre-gyp", "winston", "uuid", "moment", "dotenv", "pg", "semver", "redux",
    "redis", "dayjs", "luxon", "chalk", "debug", "cors", "helmet", "multer", "body-parser", "cheerio", "bluebird", "bcrypt", "commander", "yargs", "passport", "jsonwebtoken",
    "nodemailer", "class-validator", "rxjs", "request", "async", "minimist",
]
